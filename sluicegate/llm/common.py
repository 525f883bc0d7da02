"""Helpers of the corpus operators: columns computed from texts in Arrow batches of bounded size."""

from __future__ import annotations

import sys
import types
from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

# Texts that a worker has as Python strings at a time; one longer text is taken alone.
BATCH_BYTES = 4 << 20
# A key with over this part of all rows, and this many, is hot: fewer keys than the divisor can be.
HOT_SHARE = 1000
HOT_ROWS = 1000
HELD_OUT_OF = 5


def ship(module: str) -> None:
    """Send a module's functions to the workers by value: they need no copy of this package."""
    cloudpickle.register_pickle_by_value(sys.modules[module])


def _kept() -> dict:
    return sys.modules.setdefault("sluicegate_kept", types.ModuleType("sluicegate_kept")).__dict__


def forget() -> None:
    """Drop what the worker has kept for an operator before this one."""
    kept = _kept()
    kept["key"] = kept["value"] = None


def once(key: tuple, make: Callable[[], object]) -> object:
    """What ``make`` gives, kept by a Python worker from one task to the next.

    Only the latest value is kept: what an operator has cached goes when the next one starts.
    """
    kept = _kept()
    kept["used"] = kept.get("used", 0) + 1
    if kept.get("key") != key:
        kept["key"] = kept["value"] = None
        kept["value"] = make()
        kept["key"] = key
    return kept["value"]


def slices(texts: pa.Array, most: int = BATCH_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges with about so many bytes of text each."""
    sizes = pc.fill_null(pc.binary_length(texts), 0).to_pylist()
    start = total = 0
    for row, size in enumerate(sizes):
        if row > start and total + size > most:
            yield start, row
            start, total = row, 0
        total += size
    if start < len(sizes):
        yield start, len(sizes)


def annotate(
    docs: DataFrame,
    fields: list[StructField],
    start: Callable[[], Callable[[list[str | None]], list[pa.Array]]],
    text: str = "text",
    keep: list[str] | None = None,
    most: int = BATCH_BYTES,
) -> DataFrame:
    """Columns computed from a text column, after the columns ``keep`` (all).

    ``start`` runs in the worker and returns a function from texts to one array per field. A kept
    column with a new column's name gives way to it. No row is moved.
    """
    new = {field.name.lower() for field in fields}
    names = [c for c in (docs.columns if keep is None else keep) if c.lower() not in new]
    # Kept columns have numbers for names on the way, whatever they are called.
    hidden = [StructField(f"kept {i}", docs.schema[c].dataType, docs.schema[c].nullable) for i, c in enumerate(names)]
    schema = StructType(hidden + fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = None
        for batch in batches:
            if work is None:
                used = _kept().get("used")
                work = start()
                if _kept().get("used") == used:
                    forget()
            texts = batch.column(len(names))
            for lo, hi in slices(texts, most):
                part = batch.slice(lo, hi - lo)
                made = work(part.column(len(names)).to_pylist())
                yield pa.RecordBatch.from_arrays(
                    [*part.columns[: len(names)], *made], names=schema.names
                )

    columns = [F.col(f"`{c}`").alias(f"kept {i}") for i, c in enumerate(names)]
    made = docs.select(*columns, F.col(f"`{text}`").alias("text of the row")).mapInArrow(run, schema)
    return made.toDF(*names, *[field.name for field in fields])


def join_hot(rows: DataFrame, found: DataFrame, key: str, count: str, how: str = "inner") -> DataFrame:
    """Join ``rows`` with ``found``, a row per key with the number of the key's rows in ``count``.

    Hot keys, fewer than ``HOT_SHARE`` by their definition, are joined where the rows lie; the rest is
    shuffled. So no task gets a key with a third of all rows. ``how`` is inner or left.
    """
    total = found.agg(F.sum(count)).first()[0] or 0
    is_hot = F.col(count) > max(total // HOT_SHARE, HOT_ROWS)
    hot = found.filter(is_hot)
    shuffled = rows.join(F.broadcast(hot.select(key)), key, "left_anti").join(found.filter(~is_hot), key, how)
    return rows.join(F.broadcast(hot), key).unionByName(shuffled)


def sheltered(
    docs: DataFrame,
    work: Callable[[DataFrame, dict[str, str]], DataFrame],
    keep: list[str] | None = None,
    needs: tuple[str, ...] = (),
) -> DataFrame:
    """Run an operator over documents whose columns may have the names of its own helpers.

    ``work`` gets the frame with hidden names for the columns ``keep`` (all) and ``needs``, and a map from
    the given names to the hidden ones. What it adds comes after the kept columns; one of these with the
    name of an added column gives way to it.
    """
    kept = list(docs.columns) if keep is None else list(keep)
    used = [*kept, *[c for c in needs if c not in kept]]
    names = {c: f"column {number} of the caller" for number, c in enumerate(used)}
    worked = work(docs.select(*[F.col(f"`{c}`").alias(names[c]) for c in used]), names)
    new = [c for c in worked.columns if c not in names.values()]
    taken = {c.lower() for c in new}
    return worked.select(
        *[F.col(f"`{names[c]}`").alias(c) for c in kept if c.lower() not in taken], *[f"`{c}`" for c in new]
    )


def documents(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/documents.parquet")


def held_out(doc_id: str = "doc_id"):
    """Whether a row is kept out of learning; a null key counts as held out."""
    part = F.crc32(F.col(doc_id).cast("string").cast("binary")) % HELD_OUT_OF
    return F.coalesce(part == 0, F.lit(True))


ship(__name__)
