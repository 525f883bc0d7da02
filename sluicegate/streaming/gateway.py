"""The gateway over arriving prompts.

Scoring keeps no state between prompts. Where the whole job is a map (a scorer that is an expression,
dictionaries of measured small size), ``start_append_stream`` runs it as a native stream that appends: the
sink's log shows a batch's files when the batch is whole, so they are written exactly once. Otherwise, or
with dictionaries that change while the stream runs, ``start_gateway_stream`` has each micro-batch scored
by the batch job: every batch writes its own folder, replaced as a whole if the batch is retried.
"""

from __future__ import annotations

import os
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from sluicegate.plans.gateway import decide, layer_scores, weighted_sum
from sluicegate.sources.snapshots import Snapshots


def read_prompt_stream(
    spark: SparkSession, folder: str, name_glob: str, schema: str, files_per_batch: int = 1000
) -> DataFrame:
    """Parquet files that arrive in a folder and match a name pattern."""
    return (
        spark.readStream.schema(schema)
        .option("pathGlobFilter", name_glob)
        .option("maxFilesPerTrigger", files_per_batch)
        .parquet(folder)
    )


def read_table_stream(spark: SparkSession, path: str, schema: str, files_per_batch: int = 1000) -> DataFrame:
    """A parquet table as a stream of its files, whether it is one file or a folder of many."""
    # As a pattern, because Spark takes a plain path for a folder.
    pattern = f"{path[:-1]}[{path[-1]}]"
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(pattern)


def start_gateway_stream(
    prompts: DataFrame,
    score: Callable[[DataFrame], DataFrame],
    target: str,
    checkpoint: str,
    available_now: bool = False,
) -> StreamingQuery:
    """Score every micro-batch with ``score``; models and dictionaries are loaded once, before."""

    def write_batch(batch: DataFrame, batch_id: int) -> None:
        score(batch).write.mode("overwrite").parquet(os.path.join(target, f"batch_id={batch_id}"))

    writer = prompts.writeStream.foreachBatch(write_batch).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def start_append_stream(
    prompts: DataFrame,
    score: Callable[[DataFrame], DataFrame],
    target: str,
    checkpoint: str,
    available_now: bool = False,
) -> StreamingQuery:
    """Append the scores of arriving prompts; ``score`` must be a map, as a shuffle can't append here."""
    writer = score(prompts).writeStream.format("parquet").outputMode("append").option("path", target)
    writer = writer.option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def start_renewed_stream(
    prompts: DataFrame,
    dictionaries: dict[str, Snapshots],
    score: Callable[[DataFrame, dict[str, DataFrame]], DataFrame],
    target: Snapshots,
    checkpoint: str,
    available_now: bool = False,
) -> StreamingQuery:
    """Score every micro-batch with the latest version of each dictionary, and publish it as a version of ``target``.

    A dictionary that is published while the stream runs takes effect with the next batch. A batch is visible when
    all its rows are written; one that is retried after that isn't written again. ``Snapshots.merge`` shortens the
    list of folders that many batches leave.
    """

    def write_batch(batch: DataFrame, batch_id: int) -> None:
        latest = target.manifest()
        if latest and max([notes.get("batch", -1) for notes in latest["notes"]]) >= batch_id:
            return
        manifests = {name: table.manifest() for name, table in dictionaries.items()}
        versions = {name: found["version"] for name, found in manifests.items() if found}
        tables = {name: dictionaries[name].read(version) for name, version in versions.items()}
        target.write(score(batch, tables), append=True, notes={"batch": batch_id, "dictionaries": versions})

    writer = prompts.writeStream.foreachBatch(write_batch).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def blend_stream(scores: DataFrame, columns: dict[str, str], weights) -> DataFrame:
    """Blend the layer scores of a stream in the row: stateless, so any output mode will do."""
    layers = layer_scores({name: F.col(column) for name, column in columns.items()}, weights)
    return scores.withColumn("total_", weighted_sum(layers)).select(
        *[c for c in scores.columns if c not in columns.values()],
        F.round("total_", 4).alias("weighted_score"),
        decide(F.col("total_")).alias("action"),
    )
