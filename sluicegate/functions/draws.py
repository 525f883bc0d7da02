"""Seeded pseudo-random draws as integer arithmetic, equal on every engine and every retry."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values of a linear congruential generator with modulus 2^31.
MULTIPLIER, INCREMENT, MODULUS = 1103515245, 12345, 2**31
LOW_BITS = 8  # dropped, they repeat too soon


def stream(streams: int) -> list[tuple[int, int]]:
    """Multiplier and increment that jump 1, 2, ... steps ahead."""
    steps, a, c = [], 1, 0
    for _ in range(streams):
        a, c = a * MULTIPLIER % MODULUS, (c * MULTIPLIER + INCREMENT) % MODULUS
        steps.append((a, c))
    return steps


def seed_of(key: Column, seed: int) -> Column:
    """A start value below 2^31 from a record's key."""
    text = F.concat(F.lit(f"{seed}:"), key.cast("string"))
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("bigint") % MODULUS


def draw(start: Column, step: Column, below: Column, streams: int) -> Column:
    """The ``step``-th number drawn from a start value, in 0 .. below-1. ``step`` counts from 0."""
    a = F.expr("array(" + ",".join(f"{x}L" for x, _ in stream(streams)) + ")")
    c = F.expr("array(" + ",".join(f"{x}L" for _, x in stream(streams)) + ")")
    value = F.shiftright((start * F.get(a, step) + F.get(c, step)) % MODULUS, LOW_BITS)
    return (value % below).cast("int")
