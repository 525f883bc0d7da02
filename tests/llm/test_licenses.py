"""Places against a search of every phrase, expressions against Python's own evaluation."""

import random
import re

import pytest

from sluicegate.llm import licenses
from sluicegate.llm.queries import op12_licenses

SCANNER = licenses.Scanner(licenses.PERMITTED)
BASE = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}


def words_of(text):
    lower = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower)


def places(words, phrase):
    parts = phrase.split()
    return [i for i in range(len(words)) if words[i : i + len(parts)] == parts]


def test_query_against_brute_force(spark):
    folder = "/root/testdata/sf0.01"
    rows = spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text").collect()
    found = {row.doc_id: row for row in op12_licenses(spark, folder).collect()}
    assert len(found) == len(rows)
    hits = 0
    for row in rows:
        words = words_of(row.text)
        base = [(place, label) for phrase, label in BASE.items() for place in places(words, phrase)]
        got = found[row.doc_id]
        at = [place for place, _ in base]
        assert (got.n_words, got.n_base) == (len(words), len(base))
        assert (got.first_word, got.last_word) == (min(at, default=None), max(at, default=None))
        assert got.base_labels == ",".join(sorted({label for _, label in base}))
        assert set(filter(None, got.base_labels.split(","))) <= set(got.labels.split(","))
        assert 0 <= got.score <= 1 and (got.score > 0) == bool(got.labels)
        hits += bool(base)
    assert hits > 10


def test_every_phrase_is_found_wherever_it_stands():
    rng = random.Random(2)
    phrases = [p for p, *_ in licenses.BASE + licenses.PHRASES]
    parts = sorted({word for phrase in phrases for word in phrase.split()}) + ["é", "x9"]
    for _ in range(200):
        pieces = [rng.choice(phrases) if rng.random() < 0.4 else rng.choice(parts) for _ in range(rng.randint(0, 12))]
        text = "".join(rng.choice([" ", "-", ", ", "\n", "."]) + rng.choice([p, p.upper(), p.title()]) for p in pieces)
        words = words_of(text)
        wanted = [("base", i, label) for p, label in licenses.BASE for i in places(words, p)]
        wanted += [("phrase", i, label) for p, label, _ in licenses.PHRASES for i in places(words, p)]
        n, notices, _, _ = SCANNER.scan(text)
        got = [(r["kind"], r["word"], r["label"]) for r in notices if r["kind"] != "expression"]
        assert n == len(words) and sorted(got) == sorted(wanted), text


def build(rng, depth):
    """A random expression as tokens, and as Python over names of licences."""
    kind = rng.random()
    if depth == 0 or kind < 0.3:
        name = rng.choice(["MIT", "Apache-2.0", "GPL-2.0-only", "GPL-3.0+", "LGPL-2.1-or-later", "CC-BY-NC-4.0"])
        good = licenses.label_of(name) in licenses.PERMITTED
        if rng.random() < 0.3:
            exception = rng.choice(["Classpath-exception-2.0", "OpenSSL-exception"])
            return [name, "WITH", exception], str(good or exception.lower() in licenses.PERMITTED)
        return [name], str(good)
    left, right = build(rng, depth - 1), build(rng, depth - 1)
    if kind < 0.6:
        return left[0] + ["OR"] + right[0], f"{left[1]} or {right[1]}"
    if kind < 0.8:
        return left[0] + ["AND"] + right[0], f"{left[1]} and {right[1]}"
    inner = build(rng, depth - 1)
    return ["("] + inner[0] + [")"], f"({inner[1]})"


def test_expressions_against_python():
    rng = random.Random(5)
    for _ in range(500):
        tokens, python = build(rng, 4)
        output, complete = licenses.parse(iter(tokens))
        text, labels, good = licenses.evaluate(output, licenses.PERMITTED)
        assert complete and good == eval(python)
        names = {licenses.label_of(t) for t in tokens} - {None}
        assert labels == sorted(names)
        again, _ = licenses.parse(licenses.tokens_at(text.encode(), 0))
        assert licenses.evaluate(again, licenses.PERMITTED) == (text, labels, good)


@pytest.mark.parametrize(
    ("text", "expression", "permitted", "complete"),
    [
        ("// SPDX-License-Identifier: MIT", "MIT", True, True),
        ("SPDX-License-Identifier: (mit or gpl-2.0) and BSD-3-Clause */", "(mit OR gpl-2.0) AND BSD-3-Clause", True, True),
        ("SPDX-License-Identifier: MIT OR Apache-2.0 AND GPL-2.0", "MIT OR Apache-2.0 AND GPL-2.0", True, True),
        ("SPDX-License-Identifier: ((GPL-2.0 WITH Linux-syscall-note) OR MIT)", "GPL-2.0 WITH Linux-syscall-note OR MIT", True, True),
        ('{"license": "GPL-3.0-or-later", "x": 1}', "GPL-3.0-or-later", False, True),
        ("license: MIT and you", "MIT", True, False),
        ("license: MIT OR (", "MIT", True, False),
        ("license: (MIT AND GPL-2.0", "MIT AND GPL-2.0", False, False),
        ("license: MIT)", "MIT", True, True),
        ("license = LicenseRef-Own", "LicenseRef-Own", False, True),
        ("license: MIT WITH something", "MIT", True, False),
    ],
)
def test_tags(text, expression, permitted, complete):
    _, notices, found, score = SCANNER.scan(text)
    assert [(r["expression"], r["permitted"], r["complete"]) for r in found] == [(expression, permitted, complete)]
    assert notices and score > 0.9


@pytest.mark.parametrize("text", ["license MIT", "license:\nMIT", "license: unknown", "license:", "license: (", "license: )", "license: or"])
def test_no_expression(text):
    assert SCANNER.scan(text)[2] == []


def test_odd_rows(spark):
    long = "word (" * 200_000 + "\nSPDX-License-Identifier: " + "(" * 50_000 + "MIT"
    rows = [(1, None), (2, ""), (None, "Released under the MIT License."), (4, long), (5, "CC BY-NC, cc-by-nc 4.0")] * 2
    docs = spark.createDataFrame([(i, t, 1, "k") for i, t in rows], "doc_id long, text string, score int, notices string")
    found = licenses.scan(docs.repartition(3))
    assert found.columns == ["doc_id", "text", "n_words", "notices", "expressions", "score"]
    got = {row.doc_id: row for row in found.collect()}
    assert found.count() == len(rows)
    assert [(got[i].n_words, got[i].notices, got[i].score) for i in (1, 2)] == [(0, [], 0.0)] * 2
    assert {(n.kind, n.word, n.label) for n in got[None].notices} == {("base", 1, "mit"), ("phrase", 3, "mit")}
    assert [e.expression for e in got[4].expressions] == ["MIT"] and not got[4].expressions[0].complete
    assert [(n.word, n.label) for n in got[5].notices if n.kind == "base"] == [(0, "cc-by-nc"), (3, "cc-by-nc")]
    assert licenses.scan(docs.limit(0)).count() == 0
    strict = licenses.scan(docs.filter("doc_id = 4"), permitted=frozenset()).first()
    assert not strict.expressions[0].permitted
