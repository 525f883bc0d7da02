"""Runs against a search over all periods and places of every text."""

import hashlib
import random
import re
import zlib

import numpy as np
import pytest

from sluicegate.llm import periodicity
from sluicegate.llm.queries import op11_periodic_runs


def all_runs(words, least=4, shortest=6):
    """Every run, from its definition: maximal stretches per period, of equal stretches the smallest period."""
    found = {}
    for period in range(1, len(words) // least + 1):
        first = 0
        while first + period < len(words):
            end = first
            while end + period < len(words) and words[end] == words[end + period]:
                end += 1
            length = end + period - first
            if end > first and length >= max(shortest, least * period):
                found.setdefault((first, length), period)
            first = max(end, first + 1)
    return sorted(((s, n, p) for (s, n), p in found.items()), key=lambda run: (run[0], run[2]))


def kept(words, runs):
    dropped = {i for s, n, p in runs for i in range(s + p, s + n)}
    return [word for i, word in enumerate(words) if i not in dropped]


def random_text(rng):
    words = [rng.choice("abcde"[: rng.choice([1, 2, 2, 3, 5])]) for _ in range(rng.randint(0, 60))]
    if words and rng.random() < 0.5:
        at, period = rng.randrange(len(words)), rng.randint(1, 6)
        tail = words[at : at + period]
        words = words[:at] + [tail[i % len(tail)] for i in range(rng.randint(1, 40))] + words[at:]
    return " ".join(words)


def test_all_runs_of_random_texts():
    rng = random.Random(1)
    total = 0
    for _ in range(300):
        texts = [random_text(rng) for _ in range(rng.randint(1, 12))]
        least, shortest = rng.choice([2, 3, 4]), rng.choice([2, 4, 6, 9])
        runs, collapsed = periodicity.collapse(texts, least, shortest)
        for text, found, rest in zip(texts, runs, collapsed):
            wanted = all_runs(text.split(), least, shortest)
            assert [tuple(run) for run in found.tolist()] == wanted, (text, least, shortest)
            assert rest.decode().split() == kept(text.split(), wanted)
            total += len(wanted)
    assert total > 500


def test_extensions_are_those_of_the_words():
    rng = np.random.default_rng(2)
    words = rng.integers(4, 6, 400)
    words[100:300] = np.tile(words[100:110], 20)
    symbols = np.concatenate([[0], words[:200], [1], words[200:], [2]]).astype(np.int64)
    grammar = periodicity.Grammar(symbols, 3)
    x, y = rng.integers(0, len(symbols), (2, 3000))
    x, y = x[x != y], y[x != y]
    for forward in (True, False):
        step = 1 if forward else -1
        for a, b, n in zip(x.tolist(), y.tolist(), grammar.extend(x, y, forward).tolist()):
            wanted = 0
            while symbols[a + step * wanted] == symbols[b + step * wanted]:
                wanted += 1
            assert n == wanted, (a, b, forward)


@pytest.mark.parametrize("period", [1, 2, 7, 1000])
def test_long_texts(period):
    words = [f"w{i % period}" for i in range(50_000)]
    runs, collapsed = periodicity.collapse(["x " + " ".join(words) + " y"], 4, 6)
    assert runs[0].tolist() == [[1, 50_000, period]]
    assert collapsed[0].split() == [b"x", *[w.encode() for w in words[:period]], b"y"]


def test_query_against_the_definition(spark):
    folder = "/root/testdata/sf0.001"
    rows = spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text").collect()
    wanted = {}
    for row in rows:
        words = re.findall(r"[^\x20\x09-\x0D]+", row.text or "")
        h, n = zlib.crc32(str(row.doc_id).encode()), len(words)
        g = h // 10
        if h % 10 == 0 and n > 0:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
        runs = all_runs(words)
        best = max(runs, key=lambda run: (run[1] / run[2], -run[0], -run[2]), default=None)
        lines = "".join(f"{s},{m},{p}\n" for s, m, p in runs)
        wanted[row.doc_id] = (
            len(runs),
            *(best or (None,) * 3),
            best and 1000 * best[1] // best[2],
            hashlib.sha256(lines.encode()).hexdigest(),
            hashlib.sha256(" ".join(kept(words, runs)).encode()).hexdigest(),
        )
    found = op11_periodic_runs(spark, folder).collect()
    names = ("n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256")
    assert {row.doc_id: tuple(row[c] for c in names) for row in found} == wanted and len(found) == len(rows)
    assert sum(1 for row in wanted.values() if row[0]) > 10


def test_odd_rows_and_ties(spark):
    tie = "a " * 8 + "x " + "b c " * 8 + "y"  # both eight times their period
    rows = [(1, None), (2, ""), (3, " \n"), (None, "z " * 5), (None, "z " * 6), (7, tie), (7, tie), (8, "é　é " * 6)]
    docs = spark.createDataFrame([(i, t, 5, "q") for i, t in rows], "doc_id long, text string, runs int, `text of the row` string")
    found = periodicity.find_runs(docs.repartition(3)).withColumn("best", periodicity.strongest(periodicity.F.col("runs")))
    assert found.columns == ["doc_id", "text", "text of the row", "runs", "collapsed", "best"]
    got = sorted((row.doc_id or 0, [tuple(r) for r in row.runs], row.collapsed, row.best) for row in found.collect())
    assert [x[:3] for x in got if x[0] in (1, 2, 3)] == [(1, [], ""), (2, [], ""), (3, [], "")]
    assert sorted((x[1], x[2]) for x in got if x[0] == 0) == [([], "z z z z z"), ([(0, 6, 1)], "z")]
    assert [x[1] for x in got if x[0] == 7] == [[(0, 8, 1), (9, 16, 2)]] * 2
    assert all(tuple(x[3]) == (0, 8, 1) for x in got if x[0] == 7)
    assert [x[1] for x in got if x[0] == 8] == [[(0, 6, 1)]]  # an ideographic space is part of a word
    assert periodicity.find_runs(docs.limit(0)).count() == 0
    with pytest.raises(ValueError):
        periodicity.find_runs(docs, least=1)
