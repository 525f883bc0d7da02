"""File sources and sinks."""

from __future__ import annotations

import logging

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

logger = logging.getLogger(__name__)
CSV_OPTIONS = {"header": True, "multiLine": True, "quote": '"', "escape": '"'}
CSV_WRITE_OPTIONS = {
    "header": True,
    "quote": '"',
    "escape": '"',
    "ignoreLeadingWhiteSpace": False,
    "ignoreTrailingWhiteSpace": False,
    "emptyValue": '""',
}
RECORDS_PER_FILE = 200_000


def read_csv(
    spark: SparkSession, path: str, schema: str | T.StructType, newlines_in_fields: bool = True
) -> DataFrame:
    """CSV with a header; fields may be quoted and hold newlines. Columns are taken by name.

    A file whose fields may hold newlines is read by one task, however large it is. Say that they hold none, and
    it is split like any text.
    """
    options = {**CSV_OPTIONS, "multiLine": newlines_in_fields}
    return spark.read.schema(schema).options(**options, enforceSchema=False).csv(path)


def write_csv(frame: DataFrame, path: str, mode: str = "overwrite") -> None:
    """A CSV with quoted newlines cannot be split, so files are kept small enough for one task."""
    frame.write.mode(mode).options(**CSV_WRITE_OPTIONS, maxRecordsPerFile=RECORDS_PER_FILE).csv(path)


def read_json_lines(spark: SparkSession, path: str, schema: str | T.StructType) -> DataFrame:
    return spark.read.schema(schema).json(path)


def read_split(spark: SparkSession, path: str, split: str) -> DataFrame:
    """One named split of a data set stored by split; other splits' files are not read."""
    return spark.read.parquet(path).filter(F.col("split") == split).drop("split")


def path_exists(spark: SparkSession, path: str) -> bool:
    """Look a path up through the cluster's file system."""
    hadoop_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop_path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(hadoop_path)


def read_guarded_csv(spark: SparkSession, path: str, column: str) -> DataFrame:
    """The non-null values of one CSV column as ``text``; empty, with a warning, if the file or
    the column is missing."""
    empty = spark.createDataFrame([], "text string")
    if not path_exists(spark, path):
        logger.warning("%s not found, skipped", path)
        return empty
    # One row is enough to see the header; nothing is inferred.
    header = spark.read.options(**CSV_OPTIONS).csv(path).columns
    if column not in header:
        logger.warning("column %s not found in %s, skipped", column, path)
        return empty
    schema = T.StructType([T.StructField(name, T.StringType()) for name in header])
    rows = read_csv(spark, path, schema)
    return rows.select(F.col(column).alias("text")).na.drop(subset=["text"])


def read_text_files(spark: SparkSession, path: str) -> DataFrame:
    """One row per file of a folder: path, prompt."""
    files = spark.read.option("recursiveFileLookup", True).text(path, wholetext=True)
    return files.select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("prompt"))


def read_lexicon_json(spark: SparkSession, path: str) -> DataFrame:
    """term, weight from JSON files that each hold one map; an unreadable one counts as empty."""
    try:
        files = spark.read.text(path, wholetext=True)
    except AnalysisException:
        logger.warning("%s could not be read, taken as empty", path)
        return spark.createDataFrame([], "term string, weight double")
    parsed = files.select(F.from_json("value", "map<string,double>").alias("entries"))
    return parsed.select(F.explode("entries").alias("term", "weight")).filter("weight is not null")
