"""A corpus pipeline: toxic texts out, near copies out, benchmark passages out, personal data replaced, tokens.

Each stage is a function of the session, the documents that the stage before it wrote, and the folder of the
given tables. All but the last keep the columns of the documents, whatever they are called:

| stage | what it does |
|---|---|
| toxicity | rows whose text scores 0.5 or more go |
| near_duplicates | one row of each group of linked SimHash fingerprints stays, the one with the smallest id |
| decontamination | rows with a benchmark passage go |
| surrogates | personal data in texts is replaced |
| tokens | doc_id, n_tokens, ids_sha256 and decoded_sha256 of each row |

Null and empty texts pass all stages, with any id or none, but for near_duplicates: texts without words have the same
fingerprint and are one group. Rows with null ids are rows like others. Empty tables give empty results.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sluicegate.catalog.tables import table
from sluicegate.llm import bpe, decontamination, pii, simhash, toxicity
from sluicegate.llm.queries import SURROGATE_KEY, TOKENIZER, toxicity_model
from sluicegate.session import stored

# No SQL states a trained classifier or byte-pair merges; tests compare the stages with brute force.
ORACLE_SQL = None


def _shielded(docs: DataFrame, work: Callable[[DataFrame, str, str], DataFrame]) -> DataFrame:
    """Run an operator that adds columns of its own on documents whose columns could have the same names."""
    hidden = [f"documents column {number}" for number in range(len(docs.columns))]
    names = dict(zip(docs.columns, hidden))
    worked = work(docs.toDF(*hidden), names["doc_id"], names["text"])
    return worked.select(*[f"`{c}`" for c in hidden]).toDF(*docs.columns)


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    model = toxicity_model(spark, sf_dir)
    return _shielded(
        docs, lambda frame, key, text: toxicity.score(frame, model, text).filter(F.col("score") < 0.5)
    )


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return _shielded(docs, simhash.keep_one_of_each)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    benchmark = table(spark, sf_dir, "benchmark")
    return _shielded(
        docs,
        lambda frame, key, text: decontamination.find_benchmark(frame, benchmark, text).filter("not contaminated"),
    )


def replace_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return _shielded(docs, lambda frame, key, text: pii.replace(frame, SURROGATE_KEY, text))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return bpe.round_trip(docs, TOKENIZER, keep=["doc_id"])


STAGES = [
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("surrogates", replace_personal_data),
    ("tokens", encode),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each result is written to the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
