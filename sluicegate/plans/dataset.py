"""Training-set and signature-corpus assembly."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from sluicegate import fixed_values as fv
from sluicegate.functions import embedding as em
from sluicegate.functions import text as tx
from sluicegate.operators.ranking import dense_ids
from sluicegate.session import in_own_session
from sluicegate.sources import files


def encode_label(label: Column, vocabulary: str) -> Column:
    """Label word to 0 or 1; a word outside the vocabulary of its source is an error."""
    codes = F.create_map(*[F.lit(x) for pair in fv.LABEL_CODES[vocabulary].items() for x in pair])
    code = F.try_element_at(codes, label)
    return F.when(
        code.isNull(), F.raise_error(F.concat(F.lit("unknown label: "), F.coalesce(label, F.lit("null"))))
    ).otherwise(code)


def split_labels(rows: DataFrame, vocabulary: str) -> tuple[DataFrame, DataFrame]:
    """Rows with a label word of the vocabulary, encoded, and the rest untouched: the quarantine branch."""
    known = F.col("label").isin(*fv.LABEL_CODES[vocabulary])
    return (
        rows.filter(known).withColumn("label", encode_label(F.col("label"), vocabulary)),
        rows.filter(~known | F.col("label").isNull()),
    )


def _valid_label(label: str) -> Column:
    """Whether a label is the number 0 or 1; 0.7 is not, and neither is null."""
    return F.coalesce(F.expr(f"try_cast({label} as double)").isin(0.0, 1.0), F.lit(False))


def label_violations(rows: DataFrame, label: str = "label") -> DataFrame:
    """value, n: labels that are not the integers 0 or 1."""
    return (
        rows.filter(~_valid_label(label))
        .groupBy(F.col(label).cast("string").alias("value"))
        .agg(F.count("*").alias("n"))
    )


def checked_labels(rows: DataFrame, label: str = "label") -> DataFrame:
    """Rows with an integer label; any label outside 0 and 1, or without a value, is an error."""
    return rows.withColumn(
        label,
        F.when(_valid_label(label), F.expr(f"try_cast({label} as double)").cast("int")).otherwise(
            F.raise_error(
                F.concat(F.lit("label outside 0, 1: "), F.coalesce(F.col(label).cast("string"), F.lit("null")))
            )
        ),
    )


def drop_embedded_headers(rows: DataFrame, label: str = "label") -> DataFrame:
    """Drop header rows repeated by appends; rows without a label stay."""
    return rows.filter(~F.col(label).cast("string").eqNullSafe(F.lit(label)))


def synthetic_part(spark: SparkSession, path: str) -> DataFrame:
    raw = files.read_csv(spark, path, "prompt_clean string, label string, topic string")
    return raw.withColumnsRenamed({"prompt_clean": "text"}).select(
        tx.clean_suffix(F.col("text")).alias("text"), encode_label(F.col("label"), "synthetic").alias("label")
    )


def benchmark_part(spark: SparkSession, path: str) -> DataFrame:
    raw = files.read_csv(spark, path, "text string, label string")
    return raw.select("text", encode_label(F.col("label"), "benchmark").alias("label"))


def cleaned_part(spark: SparkSession, path: str) -> DataFrame:
    raw = files.read_csv(spark, path, "Prompt string, Value int")
    return raw.withColumnsRenamed({"Prompt": "text", "Value": "label"}).select("text", "label")


def evasion_part(spark: SparkSession, path: str) -> DataFrame:
    raw = files.read_json_lines(spark, path, "prompt string, label string")
    return raw.withColumnsRenamed({"prompt": "text"}).select(
        "text", encode_label(F.col("label"), "evasion").alias("label")
    )


def training_set(
    spark: SparkSession, paths: dict[str, str], target: str, cleaned: str | None = None
) -> DataFrame:
    """Append the four sources to one CSV, read it back, drop stray headers, check the labels.

    With ``cleaned`` the result is written there as CSV, too, and read back from it: the raw file stays as it is.
    """
    readers = {
        "synthetic": synthetic_part,
        "benchmark": benchmark_part,
        "cleaned": cleaned_part,
        "evasion": evasion_part,
    }
    for name, reader in readers.items():
        if name in paths:
            files.write_csv(reader(spark, paths[name]).select("text", "label"), target, mode="append")
    final = files.read_csv(spark, target, "text string, label string")
    checked = checked_labels(drop_embedded_headers(final))
    if cleaned is None:
        return checked
    files.write_csv(checked.select("text", "label"), cleaned)
    return files.read_csv(spark, cleaned, "text string, label int")


def label_counts(rows: DataFrame, label: str = "label") -> DataFrame:
    """label, n, the most frequent first; nulls are not counted."""
    return (
        rows.filter(F.col(label).isNotNull())
        .groupBy(label)
        .agg(F.count("*").alias("n"))
        .orderBy(F.desc("n"), F.asc(label))
    )


def written_profile(frame: DataFrame, write: Callable[[DataFrame], None], label: str | None = None) -> DataFrame:
    """Write a frame by ``write`` and profile it from what passed by: no further pass over it.

    column_name, data_type, n_rows, non_null, least and greatest (of the label column, if one is named).
    """
    given = frame.sparkSession
    (frame,) = in_own_session(frame)
    seen = Observation()
    counts = [F.count(F.col(f"`{field.name}`")).alias(f"c{i}") for i, field in enumerate(frame.schema.fields)]
    ends = [F.min(label).cast("string").alias("least"), F.max(label).cast("string").alias("greatest")] if label else []
    write(frame.observe(seen, F.count(F.lit(1)).alias("n_rows"), *counts, *ends))
    found = seen.get
    rows = [
        (
            field.name,
            field.dataType.simpleString(),
            found["n_rows"],
            found[f"c{i}"],
            found["least"] if field.name == label else None,
            found["greatest"] if field.name == label else None,
        )
        for i, field in enumerate(frame.schema.fields)
    ]
    schema = "column_name string, data_type string, n_rows long, non_null long, least string, greatest string"
    return given.createDataFrame(rows, schema)


def table_profile(frame: DataFrame) -> DataFrame:
    """column_name, data_type, n_rows, non_null: one pass over the table, one output row per column."""
    counted = frame.agg(
        F.count("*").alias("n_rows"),
        *[F.count(F.col(field.name)).alias(f"c{i}") for i, field in enumerate(frame.schema.fields)],
    )
    described = ", ".join(
        f"'{field.name}', '{field.dataType.simpleString()}', c{i}" for i, field in enumerate(frame.schema.fields)
    )
    return counted.selectExpr(
        f"stack({len(frame.columns)}, {described}) as (column_name, data_type, non_null)", "n_rows"
    )


# -- signatures -------------------------------------------------------------


def signature_corpus(labelled: DataFrame, extra: DataFrame) -> DataFrame:
    """Distinct texts of the labelled jailbreaks and of a second list.

    Equal texts collapse before the shuffle, so a text that makes up much of the input is no
    hot spot.
    """
    jailbreaks = labelled.filter(F.col("label") == "jailbreak").select("text")
    return jailbreaks.unionByName(extra.select("text").na.drop(subset=["text"])).dropDuplicates(["text"])


def write_corpus(labelled: DataFrame, extra: DataFrame, write: Callable[[DataFrame], None]) -> dict[str, int]:
    """Write the corpus by ``write``: labelled, listed and distinct_texts, counted as the rows pass by."""
    seen = {name: Observation() for name in ("labelled", "listed", "distinct_texts")}
    labelled, extra = in_own_session(labelled, extra)

    def counted(frame: DataFrame, name: str) -> DataFrame:
        return frame.observe(seen[name], F.count(F.lit(1)).alias("n"))

    jailbreaks = counted(labelled.filter(F.col("label") == "jailbreak"), "labelled")
    corpus = signature_corpus(jailbreaks, counted(extra.select("text"), "listed"))
    write(counted(corpus, "distinct_texts"))
    return {name: observed.get["n"] for name, observed in seen.items()}


def signature_index(corpus: DataFrame) -> DataFrame:
    """sig_id, text, features: dense ids and the embedding of each signature."""
    return dense_ids(corpus).select(
        "sig_id", "text", em.word_buckets(F.col("text")).alias("features")
    )


def write_signatures(index: DataFrame, path: str, records_per_file: int = 200_000) -> None:
    """Replace a stored signature table."""
    index.write.mode("overwrite").option("maxRecordsPerFile", records_per_file).parquet(path)
