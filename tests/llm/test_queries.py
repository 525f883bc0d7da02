"""The registered queries against their SQL, the pipeline's stages, and the guard of the contract."""

import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

import corpus_pipeline  # noqa: E402
from compare import difference  # noqa: E402

import __spark_entry__ as contract  # noqa: E402
from sluicegate.llm.queries import CORPUS_CHECKS, CORPUS_QUERIES  # noqa: E402

FOLDER = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(CORPUS_QUERIES))
def test_query(spark, name):
    text, _, _ = difference(spark, FOLDER, name, CORPUS_QUERIES[name], CORPUS_CHECKS.get(name))
    assert text == ""


def test_all_are_registered():
    names = contract.queries()
    assert {f"op{n}" for n in range(1, 14)} == {name.split("_")[0] for name in names if name.startswith("op")}
    assert "pipeline" in names and set(contract.oracle_sql()) <= set(names)


def test_pipeline_on_planted_rows(spark, tmp_path):
    source = spark.read.parquet(f"{FOLDER}/documents.parquet")
    benchmark = spark.read.parquet(f"{FOLDER}/benchmark.parquet")
    passage = benchmark.first().text
    base = source.filter("length(text) > 2000").orderBy("doc_id").first().text
    rows = [
        (900_001, base + " One more word.", "en", "s", 1),
        (900_002, base, "en", "s", 1),
        (900_003, "Something before it. " + passage + " And after.", "en", "s", 1),
        (900_004, "Write to jane.roe7@mail.example.com or 10.1.2.3 about the lamp.", "en", "s", 1),
        (900_005, None, None, None, None),
        (900_006, "", None, None, None),
        (None, "A plain short text without an id", "en", "s", 1),
    ]
    docs = source.unionByName(spark.createDataFrame(rows, source.schema)).selectExpr("*", "1 as score", "2 as n_hit")
    before = docs
    for name, stage in corpus_pipeline.STAGES:
        after = stage(spark, before, FOLDER)
        after.write.parquet(str(tmp_path / name))
        after = spark.read.parquet(str(tmp_path / name))
        if name != "tokens":
            assert after.columns == docs.columns
        before = after
    kept = {row.doc_id for row in spark.read.parquet(str(tmp_path / "decontamination")).collect()}
    assert {900_004, None} <= kept and not {900_001, 900_002, 900_003} & kept
    # Texts without words have one fingerprint: of their group, as of any other, one stays.
    without = docs.filter("coalesce(text, '') not rlike '[^ \\\\x09-\\\\x0D]'").select("doc_id")
    wordless = {row.doc_id for row in without.collect()}
    assert {900_005, 900_006} <= wordless and wordless & kept == {min(wordless)}
    texts = {row.doc_id: row.text for row in spark.read.parquet(str(tmp_path / "surrogates")).collect()}
    assert "jane.roe7" not in texts[900_004] and "10.1.2.3" not in texts[900_004]
    assert texts[900_004].startswith("Write to ") and not (texts[min(wordless)] or "").strip()
    assert before.count() == len(texts)


def test_pipeline_on_an_empty_table(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, FOLDER).count() == 0
