"""String similarity: 0..100, twice the longest common subsequence over both lengths."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import arrow_udf

from sluicegate.functions import text as tx
from sluicegate.functions.portable import portable


# Characters of the shorter string up to which a row of the comparison is the bits of one long: sums must not overflow.
WORD_BITS = 62


def lcs_length(left: Column, right: Column) -> Column:
    """Longest common subsequence of two short strings, inside the JVM.

    Where one of them fits a machine word, a step over the other's characters is a few operations on its bits; else
    every step makes a row of the table of lengths.
    """
    swapped = F.length(left) > F.length(right)
    pair = F.struct(F.when(swapped, right).otherwise(left).alias("a"), F.when(swapped, left).otherwise(right).alias("b"))

    def either(p: Column) -> Column:
        return F.when(F.length(p["a"]) <= WORD_BITS, _lcs_by_bits(p["a"], p["b"])).otherwise(_lcs_by_rows(p["a"], p["b"]))

    return tx.let(pair, either)


def _lcs_by_bits(left: Column, right: Column) -> Column:
    """A free bit is a character of ``left`` that no common subsequence has taken yet."""
    one = F.lit(1).cast("long")
    full = F.call_function("shiftleft", one, F.length(left)) - 1

    def places(char: Column) -> Column:
        def add(mask: Column, i: Column) -> Column:
            here = F.substring(left, i + 1, F.lit(1)) == char
            return F.when(here, mask.bitwiseOR(F.call_function("shiftleft", one, i))).otherwise(mask)

        return F.aggregate(F.sequence(F.lit(0), F.length(left) - 1), F.lit(0).cast("long"), add)

    def step(free: Column, char: Column) -> Column:
        def taken(hit: Column) -> Column:
            return (free + hit).bitwiseOR(free - hit).bitwiseAND(full)

        return tx.let(free.bitwiseAND(places(char)), taken)

    chars = F.filter(F.split(right, ""), lambda char: char != "")
    free = F.aggregate(chars, full, step)
    return F.when((F.length(left) == 0) | (F.length(right) == 0), F.lit(0)).otherwise(F.length(left) - F.bit_count(free))


def _lcs_by_rows(left: Column, right: Column) -> Column:
    size = F.length(right)
    zeros = F.array_repeat(F.lit(0), size + 1)

    def next_row(row: Column, at: Column) -> Column:
        def cell(done: Column, j: Column) -> Column:
            return F.concat(
                done,
                F.array(
                    F.when(
                        F.substring(right, j, F.lit(1)) == F.substring(left, at, F.lit(1)),
                        F.get(row, j - 1) + 1,
                    ).otherwise(F.greatest(F.get(row, j), F.get(done, j - 1)))
                ),
            )

        return F.aggregate(F.sequence(F.lit(1), size), F.array(F.lit(0)), cell)

    table = F.aggregate(F.sequence(F.lit(1), F.length(left)), zeros, next_row)
    return F.when((F.length(left) == 0) | (size == 0), F.lit(0)).otherwise(F.get(table, size))


def indel_ratio(left: Column, right: Column) -> Column:
    """Similarity of two short strings; two empty ones are alike."""
    total = F.length(left) + F.length(right)
    return F.when(total == 0, F.lit(100.0)).otherwise(
        200.0 * lcs_length(left, right).cast("double") / total
    )


@portable
def common_length(a: str, b: str) -> int:
    """Longest common subsequence by bit sets: one big-integer step per character."""
    start, shortest = 0, min(len(a), len(b))
    while start < shortest and a[start] == b[start]:
        start += 1
    end = 0
    while end < shortest - start and a[-1 - end] == b[-1 - end]:
        end += 1
    a, b = a[start : len(a) - end], b[start : len(b) - end]
    if not a or not b:
        return start + end
    where: dict[str, int] = {}
    for i, char in enumerate(a):
        where[char] = where.get(char, 0) | (1 << i)
    full = (1 << len(a)) - 1
    free = full
    for char in b:
        hit = free & where.get(char, 0)
        free = ((free + hit) | (free - hit)) & full
    return start + end + len(a) - free.bit_count()


@arrow_udf(T.ArrayType(T.DoubleType()))
@portable
def text_ratios(text: pa.Array, others: pa.Array) -> pa.Array:
    """Similarity of a text of any length to each of an array of others; null stays null."""
    out = []
    for a, group in zip(text.to_pylist(), others.to_pylist()):
        if a is None or group is None:
            out.append(None)
        else:
            out.append(
                [200.0 * common_length(a, b) / (len(a) + len(b)) if a or b else 100.0 for b in group]
            )
    return pa.array(out, pa.list_(pa.float64()))
