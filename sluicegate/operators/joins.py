"""Joins of a large table with a dimension table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BROADCAST_ROWS = 100_000
BROADCAST_BYTES = 32 * 1024 * 1024
LOCAL_ROWS = 10_000
SALTS = 64


def is_small(table: DataFrame, rows: int = BROADCAST_ROWS, size: int = BROADCAST_BYTES) -> bool:
    """Measure a table, reading no further than the row limit."""
    measured = (
        table.limit(rows + 1)
        .agg(
            F.count("*").alias("rows"),
            F.coalesce(F.sum(F.length(F.to_json(F.struct("*")))), F.lit(0)).alias("size"),
        )
        .first()
    )
    return measured["rows"] <= rows and measured["size"] <= size


def localized(table: DataFrame, rows: int = LOCAL_ROWS) -> DataFrame:
    """A table of measured small size as a local relation, read once; a larger one as it is."""
    if not is_small(table, rows):
        return table
    return table.sparkSession.createDataFrame(table.toArrow(), schema=table.schema)


def dimension_join(
    facts: DataFrame,
    table: DataFrame,
    on: str | list[str],
    how: str = "left",
    salt_by: Column | None = None,
    rows: int = BROADCAST_ROWS,
) -> DataFrame:
    """Join facts with a dimension on equal columns: broadcast if its measured size allows it.

    Beyond that the join shuffles. Text keys are always skewed, so the facts get a salt taken
    from ``salt_by`` (the same on every retry) and each dimension row is repeated per salt.
    """
    if is_small(table, rows):
        return facts.join(F.broadcast(table), on, how)
    salt = F.pmod(F.xxhash64(salt_by if salt_by is not None else F.struct("*")), F.lit(SALTS))
    spread = table.withColumn("salt_", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    keys = [on] if isinstance(on, str) else on
    # Spark doesn't see that the rows are repeated: judged by the table alone it would broadcast all of them.
    return facts.withColumn("salt_", salt.cast("int")).join(spread.hint("merge"), [*keys, "salt_"], how).drop("salt_")
