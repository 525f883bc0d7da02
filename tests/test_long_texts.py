"""No text may end an executor: the text rules on long repetitive texts."""

import re

import pytest
from pyspark.sql import functions as F

from sluicegate.functions import text as tx
from sluicegate.operators import sanitize as sz
from sluicegate.plans.gateway import profanity_terms

UNITS = [
    "\\u0041", "\\x41", "a.", "x@a.", "1 ", "(", "[", "<a", "<a>", "*", "0", "f", "{", "#", "\n", "é", "_", "A.", "//",
    "act as a ", "pretend to be ", "ignore all ", "ignore previous instructions ", "aB", "a ", "-", "4", "$", "́", "...",
    "! ", "system prompt ", "reveal your ", "```", "%", "Example 1.", "in a fictional story ",
]


@pytest.fixture(scope="module")
def long_texts(spark):
    rows = [(unit, "go " + unit * (120_000 // len(unit))) for unit in UNITS]
    return spark.createDataFrame(rows, "unit string, prompt string").repartition(4)


@pytest.mark.parametrize(
    "rule",
    [
        lambda x: sz.sanitize(x, profanity_terms()),
        sz.remove_encoded, sz.remove_format, sz.remove_meta, sz.remove_persona, sz.attacks_filter,
        tx.normalize, tx.tokens, tx.strip_intent, tx.clean_suffix, tx.sentence_chunks,
    ],
)
def test_rules_on_long_texts(spark, long_texts, rule):
    found = long_texts.select("unit", rule(F.col("prompt")).cast("string").alias("result")).collect()
    assert len(found) == len(UNITS)


def test_runs_of_escapes_are_one_blank(spark):
    escapes = ["\\u0041", "\\x41", "\\u00e9", "\\xZZ", "\\u12", "a", " ", "\\", "41", "\\U0041"]
    texts = ["".join(escapes[(i * 7 + j * j) % len(escapes)] for j in range(i % 9)) for i in range(200)]
    texts += ["x" + "\\u0041\\x42" * 20_000 + "y"]
    frame = spark.createDataFrame([(t,) for t in texts], "prompt string")
    for row in frame.select("prompt", sz.remove_encoded(F.col("prompt")).alias("found")).collect():
        wanted = re.sub(r"(?i)(\\u[0-9a-f]{4}|\\x[0-9a-f]{2})+", " ", row["prompt"])
        assert row["found"] == wanted
