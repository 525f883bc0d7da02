"""Lexicon matching against brute force over every token and term."""

import json
import random
import re

import pytest
from pyspark.sql import functions as F
from test_text import plain_normal

from sluicegate.functions.similarity import common_length, indel_ratio, text_ratios
from sluicegate.operators import baseforms as bf
from sluicegate.operators import joins
from sluicegate.operators import lexicon as lx
from sluicegate.sources import files

ROWS = lx.lexicon_rows()
FORMS = dict(lx.inflected_forms([term for term, _, _ in ROWS]))


def table_length(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        new = [0]
        for j, y in enumerate(b):
            new.append(row[j] + 1 if x == y else max(row[j + 1], new[j]))
        row = new
    return row[-1]


def test_similarity(spark):
    rng = random.Random(4)
    words = ["".join(rng.choice("abc") for _ in range(rng.randint(0, 14))) for _ in range(400)]
    pairs = list(zip(words[::2], words[1::2]))
    # Around the size of a machine word, on either side, and beyond it on both.
    sizes = [(62, 62), (62, 80), (80, 62), (61, 3), (63, 63), (63, 70), (0, 90), (70, 0), (62, 0)]
    pairs += [tuple("".join(rng.choice("abé1") for _ in range(n)) for n in size) for size in sizes]
    for a, b in pairs:
        assert common_length(a, b) == table_length(a, b)
    frame = spark.createDataFrame(pairs, "a string, b string")
    rows = frame.select(
        "a", "b", indel_ratio(F.col("a"), F.col("b")).alias("short"), text_ratios("a", F.array("b")).alias("long")
    ).collect()
    for row in rows:
        total = len(row["a"]) + len(row["b"])
        expected = 200 * table_length(row["a"], row["b"]) / total if total else 100
        assert row["short"] == pytest.approx(expected) and row["long"] == [pytest.approx(expected)]


def brute_force(text):
    tokens = [t for t in re.split("[^a-z0-9]+", plain_normal(text).lower()) if t]
    tokens = [FORMS.get(t, t) for t in tokens]
    total, labels = 0.0, set()
    for term, weight, _ in ROWS:
        if term in tokens:
            labels.add(term)
            total += weight
        elif tokens:
            ratios = [200 * table_length(term, t) / (len(term) + len(t)) for t in tokens]
            best = max(ratios)
            if best >= (95 if len(term) <= 4 else 85):
                labels.add(f"{term} (matched: '{tokens[ratios.index(best)]}')")
                total += weight
    return round(min(total, 1.0), 6), sorted(labels)


@pytest.fixture(scope="module")
def noisy(spark):
    rng = random.Random(5)

    def noise(word):
        letters = list(re.sub("[ -]", "", word))
        for _ in range(rng.randint(0, 4)):
            at = rng.randrange(len(letters)) if letters else 0
            kind = rng.random()
            if kind < 0.4 and letters:
                letters.pop(at)
            else:
                letters.insert(at, rng.choice("abcdefghijklmnopqrstuvwxyz"))
        return "".join(letters)

    texts = [" ".join(noise(rng.choice(ROWS)[0]) for _ in range(rng.randint(0, 4))) for _ in range(400)]
    texts += ["They killed with guns", "the creditcard", "credit card", "c4 ar15 ak47", "kill!", "murder!", ""]
    return [(str(i), text) for i, text in enumerate(texts)]


def scored(spark, rows, in_row=None):
    frame = spark.createDataFrame(rows, "prompt_id string, prompt string")
    result = lx.lexicon_score(frame, lx.default_lexicon(spark), lx.default_lemmas(spark), in_row).collect()
    return {r["prompt_id"]: (round(r["lexicon_score"], 6), r["triggers"]) for r in result}


def test_against_brute_force(spark, noisy):
    found = scored(spark, noisy)
    for key, text in noisy:
        assert found[key] == brute_force(text), text
    by_text = {text: found[key] for key, text in noisy}
    assert by_text["credit card"] == (0.0, []) and by_text["the creditcard"][0] == 0.4
    assert by_text["c4 ar15 ak47"] == (0.0, [])
    assert by_text["They killed with guns"] == (1.0, ["gun", "kill"])
    assert by_text["kill!"] == (0.0, []) and by_text["murder!"][1] == ["murder (matched: 'murderi')"]


def test_large_lexicon_path(spark, noisy, monkeypatch):
    in_row = scored(spark, noisy)
    assert scored(spark, noisy, in_row=False) == in_row
    frame = spark.createDataFrame(noisy, "prompt_id string, prompt string")
    terms, forms = lx.default_lexicon(spark), lx.default_lemmas(spark)
    rows = [sorted(map(tuple, lx.lexicon_matches(frame, terms, forms, in_row=way).collect())) for way in (None, False)]
    assert rows[0] == rows[1] and len(rows[0]) > 300
    # A lexicon that isn't small by measure is joined, both ways of the join agree, too.
    monkeypatch.setattr(joins, "is_small", lambda *_: False)
    monkeypatch.setattr(lx, "is_small", lambda *_: False)
    assert scored(spark, noisy) == in_row


def test_lookup_in_the_row_moves_nothing(spark, noisy):
    frame = spark.createDataFrame(noisy, "prompt_id string, prompt string")
    scores = lx.lexicon_score(frame, lx.default_lexicon(spark), lx.default_lemmas(spark))
    plan = scores._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Join" not in plan


def test_a_map_grows_by_the_tokens_it_has_not_seen(spark, noisy):
    terms = lx.default_lexicon(spark)
    tokens = lx.prompt_tokens(spark.createDataFrame(noisy, "prompt_id string, prompt string"))
    first = tokens.filter("crc32(token) % 2 = 0")
    whole = sorted(map(str, lx.fuzzy_map(tokens, terms).collect()))
    known = lx.fuzzy_map(first, terms)
    assert sorted(map(str, lx.fuzzy_map(tokens, terms, known=known).collect())) == whole
    # What a map says isn't looked up again, not even that a token matches nothing.
    claimed = spark.createDataFrame([("murderi", None, None, None, None)], known.schema)
    grown = lx.fuzzy_map(tokens, terms, known=claimed).filter("token = 'murderi'").collect()
    assert [row["term"] for row in grown] == [None]


def test_a_map_makes_its_words_once(spark):
    made = spark.sparkContext.accumulator(0)

    @F.udf("string")
    def word(number):
        made.add(1)
        return ("kill", "murderr", "plain")[number % 3]

    tokens = spark.range(60, numPartitions=3).select(word("id").alias("token"))
    known = spark.createDataFrame([("kill", "kill", 1.0, True, 100.0)], "token string, term string, weight double, is_exact boolean, ratio double")
    found = {(r["token"], r["term"]) for r in lx.fuzzy_map(tokens, lx.default_lexicon(spark), known=known).collect()}
    assert found >= {("kill", "kill"), ("murderr", "murder"), ("plain", None)} and made.value == 60


def test_counts_of_tokens(spark, noisy, monkeypatch):
    rows = [*noisy, (None, "kills kill"), ("twice", "Kill it"), ("twice", "and kills"), ("none", None), ("blank", " ")]
    rows += [("camel", "aB cD . a b c  d e"), ("camels", "theCat _x-y.z ABcD fooBAR éA")]

    def plain(rows):
        counts = {}
        for key, text in rows:
            words = [t for t in re.split("[^a-z0-9]+", plain_normal(text or "").lower()) if t]
            for pos, word in enumerate(words):
                token = FORMS.get(word, word)
                n, keys, first = counts.get(token, (0, frozenset(), pos))
                counts[token] = (n + 1, keys | ({key} - {None}), min(first, pos))
        return {token: (n, len(keys), first) for token, (n, keys, first) in counts.items()}

    def found(rows):
        frame = spark.createDataFrame(rows, "prompt_id string, prompt string")
        counted = lx.token_counts(frame, lx.default_lemmas(spark))
        plan = counted._jdf.queryExecution().optimizedPlan().toString()
        return {r["token"]: (r["n"], r["n_prompts"], r["first_pos"]) for r in counted.collect()}, plan

    counts, plan = found(rows)
    assert counts == plain(rows) and plan.count("explode") == 2
    different = [row for row in rows if row[0] != "twice"]
    counts, plan = found(different)
    # Neither ids nor texts are grouped by.
    assert counts == plain(different) and plan.count("Aggregate [") == 1
    monkeypatch.setattr(lx, "PLAN_LEMMAS", 1)
    assert found(rows)[0] == plain(rows)


def test_size_check(spark):
    frame = spark.range(50)
    assert joins.is_small(frame, rows=50) and not joins.is_small(frame, rows=49)
    assert not joins.is_small(frame, size=10)


def test_merge_replace_and_load(spark, tmp_path):
    (tmp_path / "mine.json").write_text(json.dumps({"kill": 0.1, "newterm": 0.2}))
    (tmp_path / "broken.json").write_text("{not json")
    mine = files.read_lexicon_json(spark, str(tmp_path / "mine.json"))
    base = lx.default_lexicon(spark)
    merged = {r["term"]: r["weight"] for r in lx.choose_lexicon(base, merge=mine).collect()}
    assert merged["kill"] == 0.1 and merged["newterm"] == 0.2 and len(merged) == 168
    assert lx.choose_lexicon(base, replace=mine).count() == 2
    assert files.read_lexicon_json(spark, str(tmp_path / "broken.json")).count() == 0
    assert files.read_lexicon_json(spark, str(tmp_path / "none.json")).count() == 0


def test_more_terms_never_lower_a_score(spark, noisy):
    less = spark.createDataFrame(ROWS[:80], lx.LEXICON_SCHEMA)
    frame = spark.createDataFrame(noisy, "prompt_id string, prompt string")
    few = {r[0]: r[1] for r in lx.lexicon_score(frame, less).select("prompt_id", "lexicon_score").collect()}
    more = {r[0]: r[1] for r in lx.lexicon_score(frame, lx.default_lexicon(spark)).select("prompt_id", "lexicon_score").collect()}
    assert all(more[key] >= few[key] for key in few)


def test_review_bands(spark):
    rows = spark.createDataFrame([(0.3,), (0.31,), (0.7,), (0.71,)], "s double")
    assert [r[0] for r in rows.select(lx.review_band(F.col("s"))).collect()] == ["safe", "moderate", "moderate", "high"]


def test_base_words(spark):
    known = "kill stop make carry knife box kiss church zero die big happy robber rob king bus".split()
    wanted = {
        "kills": "kill", "killed": "kill", "killing": "kill", "killings": "kill", "killer": "kill", "killers": "kill",
        "stopped": "stop", "stopping": "stop", "stopper": "stop", "making": "make", "makers": "make", "maker": "make",
        "carries": "carry", "carried": "carry", "carrier": "carry", "carriers": "carry", "knives": "knife",
        "boxes": "box", "kisses": "kiss", "churches": "church", "zeroes": "zero", "bigger": "big", "biggest": "big",
        "happiest": "happy", "happier": "happy", "robbers": "rob", "buses": "bus", "dying": "die", "dies": "die",
        "shot": "shoot", "stolen": "steal", "went": "go", "children": "child", "worse": "bad",
    }
    # No rule gives a known word for these, or they are known themselves.
    same = ["king", "robber", "sing", "bring", "wing", "thing", "ed", "s", "", "xyzing", "fest", "ring"]
    forms = spark.createDataFrame([(w,) for w in [*wanted, *same, *wanted]], "form string")
    words = spark.createDataFrame([(w,) for w in known + known], "word string")
    rows = bf.base_words(forms, words).collect()
    assert {r["form"]: r["lemma"] for r in rows} == wanted and len(rows) == len(wanted)
    own = spark.createDataFrame([("king", "ruler")], "form string, lemma string")
    assert {r["form"]: r["lemma"] for r in bf.base_words(forms, words, own).collect()}["king"] == "ruler"
    table = bf.base_words(forms, words)
    frame = spark.createDataFrame([("p", "The killers were stopped")], "prompt_id string, prompt string")
    found = lx.lexicon_matches(frame, spark.createDataFrame([("kill", 1.0), ("stop", 0.5)], "term string, weight double"), table)
    assert sorted(r["term"] for r in found.collect()) == ["kill", "stop"]
