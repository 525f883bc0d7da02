import random
import re

import pytest

from sluicegate.llm import common, secrets

KEY = "AKIA" + "Q" * 16
BLOB = "aB3" * 8


def spans(spark, texts):
    docs = spark.createDataFrame([(i, t, 0) for i, t in enumerate(texts)], "doc_id long, text string, spans int")
    found = secrets.find_secrets(docs).collect()
    assert len(found) == len(texts)
    return [[tuple(s) for s in row.spans] for row in sorted(found, key=lambda row: row.doc_id)]


def kinds(spark, texts):
    return [[kind for kind, _, _ in row] for row in spans(spark, texts)]


def strong(text):
    rules = [
        (r"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", 2, 12, re.I | re.A),
        (r"AKIA[A-Z0-9]+", 0, 18, 0),
        (r"[0-9a-f]+", 0, 16, 0),
    ]
    out = []
    for place, (pattern, group, least, flags) in enumerate(rules):
        for m in re.finditer(pattern, text or "", flags):
            if len(m.group(group)) >= least:
                out.append((m.start(), place, m.end(), secrets.ORDER[place]))
    return [(kind, begin, until) for begin, _, until, kind in sorted(out)]


def test_strong_spans_as_brute_force(spark):
    rng = random.Random(8)
    parts = ["password", "PassWd", "api_key", "apikey", "token", "=", ":", " ", '"', "'", "é", "😀", "\n", "AKIA",
             "ABCDEFGH12", "deadbeef", "0123456789abcdef", "x", "value-with/parts", "ſecret"]
    texts = ["".join(rng.choices(parts, k=rng.randint(0, 30))) for _ in range(400)] + [None, "", "token: password: abcdefghijklmnop"]
    base = {kind for kind, *_ in secrets.STRONG}
    got = [[s for s in row if s[0] in base] for row in spans(spark, texts)]
    assert got == [strong(t) for t in texts]


def test_weak_parts_need_each_other(spark):
    far = " filler" * 60
    texts = [
        "user=jane", BLOB, "https://db.example.com/x",
        f"user=jane {BLOB}", f"{KEY} {BLOB}", f"user=jane {far} {BLOB}",
        f"https://db.example.com/x user=jane {BLOB}", f"https://db.example.com/x user=jane",
        f"login: bob password={'x1' * 8} https://h.example.org", f"{KEY}",
    ]
    assert kinds(spark, texts) == [
        [], [], [], ["login", "blob"], ["access", "blob"], [], ["endpoint", "login", "blob"], [],
        ["login", "assign", "endpoint"], ["access"],
    ]


def test_weak_parts_of_strong_ones_are_dropped(spark):
    assert kinds(spark, [f"user=jane password={BLOB}"]) == [["login", "assign"]]


def test_digest_columns_of_copies(spark):
    text = f"é {KEY} and {'0f' * 10}"
    docs = spark.createDataFrame([(1, text), (1, text), (2, None)], "doc_id long, text string")
    found = secrets.find_secrets(docs)
    rows = found.select("doc_id", *[c.alias(n) for n, c in secrets.summary(found).items()]).collect()
    assert [row.spans for row in rows if row.doc_id == 1] == ["access:2:22,hex:27:47"] * 2
    assert [(row.n_assign, row.n_access, row.n_hex) for row in rows if row.doc_id == 2] == [(0, 0, 0)]
    assert secrets.find_secrets(docs.limit(0)).count() == 0


def test_many_matches_in_one_text(spark):
    text = " ".join(f"{i:016x}" for i in range(4000))
    (row,) = spans(spark, [text])
    assert row == [("hex", 17 * i, 17 * i + 16) for i in range(4000)]
    assert secrets.either_case("a_1") == "[Aa]_1"


@pytest.mark.parametrize("scope", [0, 5, 50])
def test_scopes_as_brute_force(spark, scope):
    rng = random.Random(scope)
    parts = [KEY, BLOB, "user=jane", "https://a.example.com/b", "token=" + "y7" * 8, "word", "a longer filler text"]
    texts = [" ".join(rng.choices(parts, k=rng.randint(1, 12))) for _ in range(60)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {row.doc_id: {tuple(s) for s in row.spans} for row in secrets.find_secrets(docs, scope=scope).collect()}
    every = secrets.located(secrets.scan(docs, ["doc_id"], "text")).collect()
    import hashlib

    keys = {hashlib.sha256(t.encode()).hexdigest(): i for i, t in enumerate(texts)}
    by_text = {}
    for row in every:
        by_text.setdefault(keys[row.text_key], []).append((row.kind, row.begin, row.until))
    base = {kind for kind, *_ in secrets.STRONG}
    for i in range(len(texts)):
        first = next(j for j in range(len(texts)) if texts[j] == texts[i])
        all_spans = by_text.get(keys[hashlib.sha256(texts[first].encode()).hexdigest()], [])

        def near(x, y, reach):
            return y[1] < x[2] + reach and y[2] > x[1] - reach

        hard = [s for s in all_spans if s[0] in base]
        soft = [s for s in all_spans if s[0] not in base and not any(near(s, h, 0) for h in hard)]
        names = [s for s in hard + soft if s[0] in secrets.IDENTIFIERS]
        values = [s for s in hard + soft if s[0] in secrets.SECRETS]
        wanted = set(hard)
        for s in soft:
            named, valued = any(near(s, x, scope) for x in names), any(near(s, x, scope) for x in values)
            if {"login": valued, "blob": named, "endpoint": named and valued}[s[0]]:
                wanted.add(s)
        assert got[i] == wanted


def test_one_text_in_a_third_of_the_rows(spark, monkeypatch):
    monkeypatch.setattr(common, "HOT_ROWS", 5)
    rows = [(i, "password=abcdefghijkl12") for i in range(60)] + [(i, f"x token: abcdefghijkl{i:04d}") for i in range(60, 150)]
    rows += [(i, "nothing") for i in range(150, 180)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    found = {r.doc_id: [(s.kind, s.begin, s.until) for s in r.spans] for r in secrets.find_secrets(docs).collect()}
    assert len(found) == 180 and all(found[i] == [("assign", 0, 23)] for i in range(60))
    assert all(found[i] == [("assign", 2, 2 + len(f"token: abcdefghijkl{i:04d}"))] for i in range(60, 150))
    assert all(found[i] == [] for i in range(150, 180))
