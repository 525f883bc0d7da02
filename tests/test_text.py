"""Text rules against literal cases and plain statements of each rule."""

import itertools
import random
import re
import unicodedata

import pytest
from pyspark.sql import functions as F

from sluicegate import fixed_values as fv
from sluicegate.functions import text as tx


def apply(spark, texts, **rules):
    frame = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").repartition(8)
    columns = [rule(F.col("t")).alias(name) for name, rule in rules.items()]
    return sorted(frame.select("i", "t", *columns).collect(), key=lambda row: row["i"])


def plain_normal(text):
    text = text.translate(dict(zip(map(ord, fv.LEET_FROM), fv.LEET_TO)))
    text = unicodedata.normalize("NFKD", text).encode("ascii", "ignore").decode()
    text = re.sub("[-_.]", " ", text)
    text = re.sub("([a-z])(?=[A-Z])", r"\1 ", text)
    run = r"(?:\b[a-zA-Z0-9]\s+)+[a-zA-Z0-9]\b"
    text = re.sub(run, lambda found: "".join(c for c in found[0] if c != " "), text)
    return re.sub(r"(.)\1\1+", r"\1", text)


@pytest.mark.parametrize(
    "text, expected",
    [
        ("k i l l", "kill"),
        ("k.1.l.l", "kill"),
        ("muuuuurder", "murder"),
        ("kill!", "killi"),
        ("SystemKill", "System Kill"),
        ("a" + " " * 200 + "b", "ab"),
        ("a \t b", "a\tb"),
        ("ﬁne ½ ⓀⒾll", "fine 12 KIll"),
    ],
)
def test_normalize(spark, text, expected):
    assert apply(spark, [text], out=tx.normalize)[0]["out"] == expected


def test_normalize_random(spark):
    rng = random.Random(1)
    texts = ["".join(rng.choice("abAB1 \t\n  \x1c.-_!'kkk") for _ in range(rng.randint(0, 60))) for _ in range(4000)]
    points = [p for p in range(0x80, 0x11000, 3) if not 0xD800 <= p < 0xE000]
    points += list(range(0x1F100, 0x1F1B0)) + list(range(0x1D400, 0x1D440))
    texts += [f"x{chr(p)}{chr(p)}y" for p in points]
    for row in apply(spark, texts, out=tx.normalize):
        assert row["out"] == plain_normal(row["t"]), repr(row["t"])


def plain_chunks(text):
    chunks = []
    for sentence in re.compile("(?<=[.!?]) +").split(text):
        numbered = list(enumerate(sentence.split()))
        pieces = [sentence]
        if len(numbered) > 200:
            groups = itertools.groupby(numbered, key=lambda pair: pair[0] // 200)
            pieces = [" ".join(word for _, word in group) for _, group in groups]
        chunks.extend(filter(None, map(str.strip, pieces)))
    return chunks


def test_sentence_chunks_and_words(spark):
    rng = random.Random(2)
    texts = ["".join(rng.choice("ab.!? \n\x1c \x85") for _ in range(rng.randint(0, 50))) for _ in range(2000)]
    texts += [" ".join(["w"] * n) for n in (199, 200, 201, 401)]
    for row in apply(spark, texts, chunks=tx.sentence_chunks, n=tx.word_count, s=tx.strip):
        assert row["chunks"] == plain_chunks(row["t"])
        assert row["n"] == len(row["t"].split())
        assert row["s"] == row["t"].strip()
    sizes = [len(c.split()) for c in plain_chunks(" ".join(["w"] * 401))]
    assert sizes == [200, 200, 1]


def test_strip_intent_and_suffix(spark):
    rng = random.Random(3)
    bits = [
        "Ignore ", "all ", "previous ", "instructions", "act as ", "a ", "an", "\n", "\x1c", "do not refuse",
        "do n't refuse", "don't refuse", "hypothetically speaking", "developer mode: on", "in fictional story",
        "write a fictional story", " ", "\r", ". Example 1.", ".\n Example ٣.",
    ]
    texts = ["".join(rng.choice(bits) for _ in range(rng.randint(1, 8))) for _ in range(3000)]

    def plain(text):
        rest = text
        for pattern in fv.INTENT_PATTERNS:
            rest = re.compile(pattern, re.IGNORECASE).sub("", rest)
        return text if rest == text else rest.strip()

    for row in apply(spark, texts, stripped=tx.strip_intent, clean=tx.clean_suffix):
        assert row["stripped"] == plain(row["t"]), repr(row["t"])
        assert row["clean"] == re.sub(fv.EXAMPLE_SUFFIX, "", row["t"]).strip()


def test_previews(spark):
    rows = apply(spark, ["x" * 512, "x" * 513], long=tx.preview, short=lambda t: tx.preview(t, 50))
    assert [len(r["long"]) for r in rows] == [512, 515]
    assert rows[0]["short"] == "x" * 50 + "..."
