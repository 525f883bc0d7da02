"""Near-duplicates by SimHash: signatures with one bit wiped, joined on equality.

A fingerprint takes a bit where over half the hashes of a text's shingles have it. Two fingerprints that differ
by at most ``most_bits`` bits are cut into ``most_bits // 2 + 1`` segments: one of these differs by at most one
bit. Every segment is indexed once per bit with that bit wiped, so segments with at most one different bit agree
in some *variant*; equal variants are joined and the whole fingerprints compared. A pair that meets in several
variants is kept in one of them only.

Equal fingerprints collapse before the join, so copies never meet as pairs, however many there are. Members of
a variant agree in all other bits of a segment: their number follows the different fingerprints around one
point, not the rows. Links become components by alternating stars (see ``graph``).

``keep_one_of_each`` keeps of each group the row with the smallest key. Where rows share that key, their hash over
all columns decides, so a retried task keeps the same one; rows equal in all columns count as one.

Null texts and texts without words have the fingerprint zero. Repeated rows stay, with the same component; null
ids are never a component's smallest id unless there is no other. Rows are texts of any length; memory per task
is 4 MB of texts, or one longer text, and the hashes of a slice of its shingles. Empty tables give empty results.
Other columns may have any names.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField

from sluicegate.llm.common import annotate, join_hot, ship
from sluicegate.llm.graph import components
from sluicegate.session import stored

SEED = 42
BITS = 64
SHINGLE = 3
MOST_BITS = 3
# Hashes whose bits are counted at a time.
HASHES = 1 << 16
LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode().translate(LOWER).split()


def shingles(words: list[bytes], size: int) -> list[bytes]:
    """Space-joined shingles, repeats included; all words if they are fewer; none without words."""
    if not words:
        return []
    return [b" ".join(words[i : i + size]) for i in range(max(1, len(words) - size + 1))]


def hashes(features) -> np.ndarray:
    digest = xxhash.xxh64_intdigest
    return np.array([digest(feature, SEED) for feature in features], dtype=np.uint64)


def majority(values: np.ndarray) -> int:
    """The bits that over half the values have, as a signed number."""
    counts = np.zeros(BITS, dtype=np.int64)
    for at in range(0, len(values), HASHES):
        bits = np.unpackbits(values[at : at + HASHES].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        counts += bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * counts > len(values), bitorder="little").view("<i8")[0])


def add_fingerprints(
    docs: DataFrame,
    text: str = "text",
    fingerprint: str = "fingerprint",
    size: int = SHINGLE,
    keep: list[str] | None = None,
) -> DataFrame:
    """Add the 64-bit fingerprint of a text column as a long."""

    def start():
        def work(texts):
            return [pa.array([majority(hashes(shingles(words_of(t), size))) for t in texts], pa.int64())]

        return work

    return annotate(docs, [StructField(fingerprint, LongType())], start, text, keep)


def _signed(number: int) -> int:
    """The long with the lowest 64 bits of a number."""
    return (number + (1 << 63)) % (1 << 64) - (1 << 63)


def segments(most_bits: int) -> list[tuple[int, int]]:
    """Offset and width of segments of which one has at most one of ``most_bits`` different bits."""
    number = most_bits // 2 + 1
    return [(BITS * s // number, BITS * (s + 1) // number - BITS * s // number) for s in range(number)]


def variants(fingerprints: DataFrame, most_bits: int) -> DataFrame:
    """variant, value, fingerprint: each segment once per bit, with that bit wiped.

    The variant's number is ``BITS`` times that of the segment, plus the bit.
    """
    made = []
    for number, (offset, width) in enumerate(segments(most_bits)):
        value = F.shiftrightunsigned("fingerprint", offset).bitwiseAND(F.lit(_signed((1 << width) - 1)))
        for bit in range(width):
            wiped = value.bitwiseAND(F.lit(_signed(~(1 << bit))))
            made.append(F.struct(F.lit(number * BITS + bit).alias("variant"), wiped.alias("value")))
    return fingerprints.select("fingerprint", F.explode(F.array(*made)).alias("v")).select(
        "v.variant", "v.value", "fingerprint"
    )


def _first_meeting(difference: Column, variant: Column, most_bits: int) -> Column:
    """Whether a pair's variant is the first in which it meets."""
    cases, earlier = [], F.lit(True)
    segment, bit = F.floor(variant / BITS), variant % BITS
    for number, (offset, width) in enumerate(segments(most_bits)):
        part = F.shiftrightunsigned(difference, offset).bitwiseAND(F.lit(_signed((1 << width) - 1)))
        wiped = F.call_function("shiftleft", F.lit(1).cast("long"), bit)
        here = ((part == 0) & (bit == 0)) | (part == wiped)
        cases.append((number, here & earlier))
        earlier = earlier & (F.bit_count(part) > 1)
    # Cases, not alternatives: a condition on one side alone would be pushed below its exchange.
    result = cases[0][1]
    for number, case in cases[1:]:
        result = F.when(segment == number, case).otherwise(result)
    return result


def links(fingerprints: DataFrame, most_bits: int = MOST_BITS) -> DataFrame:
    """a, b: all pairs of different fingerprints, a < b, with at most ``most_bits`` different bits."""
    indexed = variants(fingerprints, most_bits)
    # Both sides are the same frame under two aliases, so that one exchange of the index serves both.
    one, other = indexed.alias("one"), indexed.alias("other")
    a, b = F.col("one.fingerprint"), F.col("other.fingerprint")
    difference = a.bitwiseXOR(b)
    same = (F.col("one.variant") == F.col("other.variant")) & (F.col("one.value") == F.col("other.value"))
    # The files of the fingerprints are small, so Spark would broadcast the index, 64 rows for each of them.
    pairs = one.join(other.hint("merge"), same).filter(
        (a < b)
        & (F.bit_count(difference) <= most_bits)
        & _first_meeting(difference, F.col("one.variant"), most_bits)
    )
    return pairs.select(a.alias("a"), b.alias("b"))


def grouped(printed: DataFrame, best: Column, most_bits: int) -> DataFrame:
    """fingerprint, root, best, rows, stored: a component's least fingerprint, and of each fingerprint the
    least ``best`` and the number of rows."""
    each = stored(printed.groupBy("fingerprint").agg(F.min(best).alias("best"), F.count("*").alias("rows")), "each")
    rooted = components(links(each.select("fingerprint"), most_bits)).withColumnRenamed("node", "fingerprint")
    return stored(
        each.join(rooted, "fingerprint", "left").select(
            "fingerprint", F.coalesce("root", "fingerprint").alias("root"), "best", "rows"
        ),
        "grouped",
    )


def group_documents(
    docs: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    size: int = SHINGLE,
    most_bits: int = MOST_BITS,
) -> DataFrame:
    """key, fingerprint (long), component_id: the smallest key that links reach, for every row."""
    named = docs.select(F.col(f"`{key}`").alias("row key"), F.col(f"`{text}`").alias("row text"))
    printed = stored(add_fingerprints(named, "row text", "fingerprint", size, ["row key"]), "fingerprints")
    groups = grouped(printed, F.col("row key"), most_bits)
    least = groups.groupBy("root").agg(F.min("best").alias("component_id"), F.count("*").alias("members"))
    # A component may have very many different fingerprints.
    named_groups = join_hot(groups, stored(least, "least"), "root", "members")
    named_groups = named_groups.select("fingerprint", "component_id", "rows")
    return join_hot(printed, stored(named_groups, "components"), "fingerprint", "rows").select(
        F.col("row key").alias(key), "fingerprint", "component_id"
    )


def row_hashes(docs: DataFrame) -> list[Column]:
    """Two hashes, 128 bits together, over all columns and which of them are null."""
    nulls = [F.col(f"`{c}`").isNull() for c in docs.columns]
    values = [
        F.to_json(F.struct(value)) if "map<" in field.dataType.simpleString() else value
        for field in docs.schema
        for value in [F.col(f"`{field.name}`")]
    ]
    return [F.xxhash64(F.lit(seed), *nulls, *values) for seed in (1, 2)]


def keep_one_of_each(
    docs: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    size: int = SHINGLE,
    most_bits: int = MOST_BITS,
) -> DataFrame:
    """The rows of ``docs``, one of each group of linked fingerprints: the one with the smallest key."""
    hidden = [f"column {number}" for number in range(len(docs.columns))]
    names = dict(zip(docs.columns, hidden))
    frame = docs.toDF(*hidden)
    ones, others = row_hashes(frame)
    frame = frame.withColumn("row one", ones).withColumn("row other", others)
    named = frame.select(F.col(names[key]).alias("row key"), "row one", "row other", F.col(names[text]).alias("row text"))
    keep = ["row key", "row one", "row other"]
    printed = stored(add_fingerprints(named, "row text", "fingerprint", size, keep), "fingerprints")
    order = F.struct(F.col("row key").isNull().alias("no key"), *[F.col(c) for c in keep])
    groups = grouped(printed, order, most_bits)
    best = groups.groupBy("root").agg(F.min("best").alias("best"))
    keepers = stored(best.select("best.row one", "best.row other"), "keepers")
    rows = ["row one", "row other"]
    return frame.join(keepers, rows, "left_semi").dropDuplicates(rows).select(*hidden).toDF(*docs.columns)


ship(__name__)
