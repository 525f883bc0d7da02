import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField

from sluicegate.llm import (
    alignment,
    bpe,
    common,
    decontamination,
    language,
    licenses,
    periodicity,
    pii,
    quality,
    queries,
    secrets,
    simhash,
    tokens,
    toxicity,
    urls,
)


def test_batches_are_bounded_and_long_texts_stand_alone():
    texts = pa.array(["a" * 10, None, "b" * 95, "c" * 200, "d", "e" * 99])
    assert list(common.slices(texts, 100)) == [(0, 2), (2, 3), (3, 4), (4, 6)]
    assert list(common.slices(pa.array([], pa.string()), 100)) == []


def test_a_worker_keeps_the_latest_value_only():
    made = []
    for key in ("a", "a", "b", "a"):
        common.once((key, 1), lambda key=key: made.append(key) or key)
    assert made == ["a", "b", "a"]


def test_new_columns_replace_kept_ones_of_their_name(spark):
    docs = spark.createDataFrame([(1, "ab", "old"), (None, None, "old")], "doc_id long, text string, SIZE string")

    def start():
        return lambda texts: [pa.array([len(t or "") for t in texts], pa.int64())]

    found = common.annotate(docs, [StructField("size", LongType())], start)
    assert found.columns == ["doc_id", "text", "size"]
    assert [tuple(row) for row in found.collect()] == [(1, "ab", 2), (None, None, 0)]


def test_held_out_rows(spark):
    import zlib

    rows = spark.createDataFrame([(i,) for i in range(50)] + [(None,)], "doc_id long")
    for row in rows.select("doc_id", common.held_out().alias("out")).collect():
        assert row.out == (row.doc_id is None or zlib.crc32(str(row.doc_id).encode()) % 5 == 0)
    assert rows.filter(F.col("doc_id").isNull()).count() == 1


HELPERS = [
    "text of the row", "row text", "key of the text", "text_key", "pieces", "new parts", "name words", "mined url", "mined",
    "text to search", "row words", "row lines", "windows", "language", "origin", "high symbols", "low word_length",
    "language of the row", "rows of the text", "kept 0", "column 0 of the caller", "row key", "row one", "fixed", "tokens",
    "spans of block 0", "links", "rows", "chunk",
]


def operators():
    """Every operator over a frame of documents, and what it adds."""
    tokenizer, pieces = queries.TOKENIZER, queries.PIECE_TOKENIZER
    model = toxicity.Model(np.zeros(16), 0.0)
    languages = language.Model(["en"], np.zeros((16, 1)), np.ones((len(language.SCRIPTS), 1), dtype=bool))
    return {
        "pii": lambda docs: pii.replace(docs, "k", counts="n_mentions"),
        "language": lambda docs: language.label(docs, languages),
        "tokens": lambda docs: tokens.count_tokens(docs, tokenizer, chunk=64, overlap=16),
        "quality": lambda docs: quality.judge(docs),
        "urls": lambda docs: urls.judge(docs, url="text"),
        "bpe": lambda docs: bpe.encode_column(docs, tokenizer),
        "simhash": lambda docs: simhash.keep_one_of_each(docs),
        "decontamination": lambda docs: decontamination.find_benchmark(docs, docs.limit(1), item="doc_id"),
        "secrets": lambda docs: secrets.find_secrets(docs),
        "toxicity": lambda docs: toxicity.score(docs, model),
        "periodicity": lambda docs: periodicity.find_runs(docs),
        "licenses": lambda docs: licenses.scan(docs),
        "alignment": lambda docs: alignment.align(docs, tokenizer, pieces),
    }


@pytest.mark.parametrize("name", sorted(operators()))
def test_columns_named_like_helpers_stay(spark, name):
    texts = ["Mr. John Smith, a@b.org http://x.org/y password=abcdefghijkl12", None, "", "word " * 60]
    kinds = ", ".join(f"`{c}` int" for c in HELPERS)
    rows = [(i, t, "en", "s", *range(len(HELPERS))) for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, f"doc_id long, text string, lang string, source string, {kinds}")
    found = operators()[name](docs)
    added = set(found.columns) - set(docs.columns)
    gave_way = {c for c in HELPERS if found.columns.count(c) == 1 and c in ("tokens", "links", "windows")}
    got = found.collect()
    assert len(got) == (3 if name == "simhash" else 4) and (added or name == "simhash")
    for row in got:
        values = row.asDict()
        for number, column in enumerate(HELPERS):
            if column not in gave_way:
                assert values[column] == number, column
    assert operators()[name](docs.limit(0)).count() == 0


def test_an_operator_without_a_cache_drops_the_one_before(spark):
    fields = [StructField("n", LongType())]

    def keeping():
        common.once(("kept by a test", 1), lambda: "something large")
        return lambda texts: [pa.array([int(common._kept()["value"] is not None)] * len(texts), pa.int64())]

    def plain():
        return lambda texts: [pa.array([int(common._kept().get("value") is not None)] * len(texts), pa.int64())]

    docs = spark.createDataFrame([(i, "a") for i in range(40)], "doc_id long, text string").repartition(8)
    assert {r.n for r in common.annotate(docs, fields, keeping).collect()} == {1}
    # Dropped after the start, before the first batch is worked on.
    assert {r.n for r in common.annotate(docs, fields, plain).collect()} == {0}
