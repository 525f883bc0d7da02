import math
import random
import re
import zlib

import numpy as np
import pytest

from sluicegate.llm import toxicity

CLEAN = "house garden river window letter morning table season paper number little winter answer people".split()
BAD = ["grumblehead", "snotwaffle", "dreckface"]


def corpus(seed, n):
    rng = random.Random(seed)
    texts, labels = [], []
    for i in range(n):
        words = rng.choices(CLEAN, k=rng.randint(20, 80))
        if i % 5 == 0:
            words[rng.randrange(len(words))] = rng.choice(BAD)
        texts.append(" ".join(words))
        labels.append(int(i % 5 == 0))
    return texts, labels


@pytest.fixture(scope="module")
def model():
    texts, labels = corpus(1, 500)
    return toxicity.train([toxicity.bag(t, toxicity.BUCKETS) for t in texts], np.array(labels), 0.2)


def test_unseen_texts_and_misspellings(model):
    scorer = toxicity.Scorer(model)
    texts, labels = corpus(2, 200)
    scores = np.array(scorer.score(texts))
    assert ((scores >= 0.5) == np.array(labels)).mean() >= 0.98
    clean = "the garden by the river had a table and a window in the morning"
    for word in ("grumblehed", "snotwafle", "dreckfacee"):
        low, high = scorer.score([clean, f"{clean} {word}"])
        assert high > low and high > 0.5


def test_scores_do_not_depend_on_batches_or_order(model):
    texts, _ = corpus(3, 50)
    together = toxicity.Scorer(model).score(texts)
    assert together == [toxicity.Scorer(model).score([t])[0] for t in texts]
    assert together[0] == toxicity.Scorer(model).score([" ".join(reversed(texts[0].split()))])[0]


def test_weights_are_averages(model):
    ids, weights = toxicity.bag("one two two", toxicity.BUCKETS)
    assert len(ids) == len(set(ids.tolist()))
    assert weights.sum() == pytest.approx(2 / toxicity.spread(2))
    assert len(toxicity.bag(None, toxicity.BUCKETS)[0]) == 0


def test_frames(spark, model):
    texts, labels = corpus(4, 300)
    rows = [(i, t) for i, t in enumerate(texts)] + [(None, "x"), (900, None), (900, None), (901, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    marks = spark.createDataFrame(
        [(i, n) for i, n in enumerate(labels)] + [(None, 1), (5, None), (6, 7)], "doc_id long, toxic int"
    )
    first, second = toxicity.fit(docs, marks), toxicity.fit(docs.repartition(7), marks.repartition(3))
    assert np.array_equal(first.weights, second.weights) and first.intercept == second.intercept
    scored = toxicity.score(docs, first).collect()
    assert len(scored) == len(rows) and all(0 <= row.score <= 1 for row in scored)
    right = [(row.score >= 0.5) == bool(labels[row.doc_id]) for row in scored if row.doc_id in range(300)]
    assert np.mean(right) >= 0.98
    assert toxicity.score(docs.limit(0), first).count() == 0


def test_one_class_or_none(spark):
    docs = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    for marks, score in (([(1, 1)], 1.0), ([(1, 0)], 0.0), ([], 0.0)):
        frame = spark.createDataFrame(marks, "doc_id long, toxic int")
        assert toxicity.score(docs, toxicity.fit(docs, frame)).first().score == pytest.approx(score, abs=1e-6)


def test_the_sample_is_bounded_in_rows(spark, monkeypatch):
    texts, labels = corpus(5, 60)
    rows = [(i, t) for i, t in enumerate(texts)] + [(0, f"{texts[0]} w{i}") for i in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    marks = spark.createDataFrame([(i, n) for i, n in enumerate(labels)] + [(0, 1)] * 50, "doc_id long, toxic int")
    seen = []

    def watched(bags, answers, *more):
        seen.append(answers.tolist())
        return toxicity.Model(np.zeros(toxicity.BUCKETS), 0.0)

    monkeypatch.setattr(toxicity, "train", watched)
    toxicity.fit(docs, marks, rows_per_class=20)
    assert seen[0].count(0) == 20 and seen[0].count(1) == 20
    toxicity.fit(docs, marks, rows_per_class=12)
    toxicity.fit(docs, marks.filter("doc_id < 3"), rows_per_class=12)
    assert [seen[1].count(1), seen[2].count(0), seen[2].count(1)] == [12, 2, 12]


def plainly_trained(texts, labels, buckets, epochs, seed=7):
    """The same descent with loops over texts, words and dimensions."""
    bags = []
    for text in texts:
        words = set(re.findall(r"[^\W\d_]+", text.lower()))
        bag = {}
        for word in words:
            marked = f"<{word}>"
            grams = [marked[i : i + n] for n in (3, 4, 5) for i in range(len(marked) - n + 1)] + [marked]
            for gram in grams:
                place = zlib.crc32(gram.encode()) % buckets
                bag[place] = bag.get(place, 0) + 1 / len(grams) / (2.5 * math.sqrt(len(words) + 30))
        bags.append(bag)
    have = [sum(place in bag for bag in bags) for place in range(buckets)]
    gain = [
        (math.log((1 + len(bags)) / (1 + n)) / math.log(1 + len(bags))) ** 2 if n >= 2 else 0.0 for n in have
    ]
    sizes = [labels.count(0), labels.count(1)]
    rng = np.random.default_rng(seed)
    table, layer, shift = rng.normal(0, 0.1, (4, buckets)), rng.normal(0, 1.0, (4, 2)), np.zeros(2)
    pace, power = [np.zeros_like(v) for v in (table, layer, shift)], [0.0] * 3
    batches = -(-len(bags) // toxicity.BATCH)
    steps, step = epochs * batches + 1, 0
    for _ in range(epochs):
        order = rng.permutation(len(bags)).tolist()
        for at in range(0, len(order), toxicity.BATCH):
            rows = order[at : at + toxicity.BATCH]
            grads = [np.zeros_like(v) for v in (table, layer, shift)]
            for row in rows:
                mean = [sum(table[d][p] * w * gain[p] for p, w in bags[row].items()) for d in range(4)]
                odds = [sum(mean[d] * layer[d][k] for d in range(4)) + shift[k] for k in (0, 1)]
                top = max(odds)
                share = [math.exp(x - top) / sum(math.exp(y - top) for y in odds) for x in odds]
                weight = 0.5 / sizes[labels[row]] * len(labels) / len(rows)
                wrong = [(share[k] - (k == labels[row])) * weight for k in (0, 1)]
                for d in range(4):
                    back = sum(wrong[k] * layer[d][k] for k in (0, 1))
                    for p, w in bags[row].items():
                        grads[0][d][p] += back * w * gain[p]
                    for k in (0, 1):
                        grads[1][d][k] += mean[d] * wrong[k]
                for k in (0, 1):
                    grads[2][k] += wrong[k]
            step += 1
            for i, value in enumerate((table, layer, shift)):
                pace[i] = 0.9 * pace[i] + 0.1 * grads[i]
                power[i] = 0.99 * power[i] + 0.01 * float((grads[i] ** 2).mean())
                size = math.sqrt(power[i] / (1 - 0.99**step)) + 1e-12
                value -= toxicity.RATE * (1 - step / steps) * pace[i] / size / (1 - 0.9**step)
    weights = [sum((layer[d][1] - layer[d][0]) * table[d][p] for d in range(4)) * gain[p] for p in range(buckets)]
    return weights, float(shift[1] - shift[0])


def test_training_and_scores_by_brute_force(spark, monkeypatch):
    monkeypatch.setattr(toxicity, "LEAST_STEPS", 1)
    monkeypatch.setattr(toxicity, "EPOCHS", 3)
    monkeypatch.setattr(toxicity, "BATCH", 16)
    texts, labels = corpus(6, 40)
    buckets = 512
    model = toxicity.train([toxicity.bag(t, buckets) for t in texts], np.array(labels), 0.2, buckets)
    weights, intercept = plainly_trained(texts, labels, buckets, 3)
    assert np.allclose(model.weights, weights, atol=1e-8) and model.intercept == pytest.approx(intercept)
    more = texts[:10] + ["Grumblehead, grumblehead!", "", "12", "é ü"]
    docs = spark.createDataFrame(list(enumerate(more)), "doc_id int, text string")
    for row in toxicity.score(docs, model).collect():
        words = set(re.findall(r"[^\W\d_]+", row.text.lower()))
        total = 0.0
        for word in words:
            marked = f"<{word}>"
            grams = [marked[i : i + n] for n in (3, 4, 5) for i in range(len(marked) - n + 1)] + [marked]
            total += sum(weights[zlib.crc32(g.encode()) % buckets] for g in grams) / len(grams)
        odds = total / (2.5 * math.sqrt(len(words) + 30)) + intercept
        assert row.score == pytest.approx(1 / (1 + math.exp(-odds)))
