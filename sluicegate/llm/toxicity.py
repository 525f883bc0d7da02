"""Toxicity from bags of subwords: averaged n-gram embeddings under a linear softmax.

A word is the bag of its character n-grams with word borders, hashed into a fixed number of buckets; its
vector is the mean of their embeddings. The vector of a text averages its different words and some neutral ones,
n-grams that few texts have weighing more, and a linear softmax over it gives the classes. Embeddings and softmax are trained jointly in numpy. A misspelling that was never
seen still shares most n-grams with the words it comes from.

*Learning* takes a bounded sample of the labelled rows: up to ``rows_per_class`` of each label, the lowest
hashes of their keys, with whole texts. The bound holds for rows of text: of a key with many, the one with the
lowest hash comes first, and others fill what is left. Tasks turn them into bucket weights, at most ``buckets`` numbers a row,
and only these go to the driver. Both classes have equal weight in learning, however rare one is.

*Scoring* needs one number per bucket, as everything above is linear. The model, of fixed size, is broadcast.
Each worker scores a new word once. No row is moved.

Null texts and texts without a letter get the score of the intercept alone. Rows whose label is null or not 0
or 1 aren't learned from. With labels of one class only, or none, the score is the share of label 1 (0 if
there is no label). Repeated labels count once, as do rows that repeat key and text in learning; each row is scored.
Very long texts are rows like others: memory per task is the model, 4 MB of texts (or one longer text) and a cache of
bounded size. Empty tables give empty results. Other columns may have any names; one called score gives way.
"""

from __future__ import annotations

import math
import re
import zlib
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField

from sluicegate.llm.common import annotate, forget, once, ship
from sluicegate.session import stored

BUCKETS = 1 << 16
DIMENSIONS = 4
SHORTEST, LONGEST = 3, 5
ROWS_PER_CLASS = 2000
EPOCHS = 14
LEAST_STEPS = 250
BATCH = 128
RATE = 0.1
CACHED_PIECES = 200_000
# Words of no meaning that every text has besides its own: a few words alone prove little.
NEUTRAL_WORDS = 30
SCALE = 2.5
# N-grams of fewer sampled texts aren't learned.
LEAST_TEXTS = 2
LETTERS = re.compile(r"[^\W\d_]+")


def subwords(word: str, buckets: int) -> list[int]:
    """Buckets of a word's n-grams, and of the word itself."""
    marked = f"<{word}>"
    grams = [marked[i : i + n] for n in range(SHORTEST, LONGEST + 1) for i in range(len(marked) - n + 1)]
    grams.append(marked)
    return [zlib.crc32(gram.encode()) % buckets for gram in grams]


def spread(words: int) -> float:
    """By what the sum over a text's different words is divided.

    That is their mean times the square root of their number: chance moves such a mean as far in a long
    text as in a short one, so one threshold fits both.
    """
    return SCALE * math.sqrt(words + NEUTRAL_WORDS)


def bag(text: str | None, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of a text's different words, and their weights in its mean."""
    words = set(LETTERS.findall((text or "").lower()))
    ids, weights = [], []
    for word in words:
        parts = subwords(word, buckets)
        ids.extend(parts)
        weights.extend([1 / len(parts) / spread(len(words))] * len(parts))
    unique, place = np.unique(np.array(ids, dtype=np.int32), return_inverse=True)
    return unique, np.bincount(place, weights=weights, minlength=len(unique))


@dataclass
class Model:
    """What a bucket adds to the log-odds of label 1, and their intercept."""

    weights: np.ndarray
    intercept: float


def _softmax(scores: np.ndarray) -> np.ndarray:
    raised = np.exp(scores - scores.max(axis=1, keepdims=True))
    return raised / raised.sum(axis=1, keepdims=True)


def train(
    bags: list[tuple[np.ndarray, np.ndarray]],
    labels: np.ndarray,
    share: float,
    buckets: int = BUCKETS,
    seed: int = 7,
) -> Model:
    """Embeddings and softmax by gradient descent, with both classes of equal weight.

    ``share``, that of label 1, matters only if one class is missing.
    """
    classes = np.bincount(labels, minlength=2) if len(labels) else np.zeros(2)
    if min(classes) == 0:
        odds = np.log(max(share, 1e-9) / max(1 - share, 1e-9))
        return Model(np.zeros(buckets), float(odds))
    # N-grams that most texts have say little, and those of a single text nothing about others.
    texts = np.bincount(np.concatenate([ids for ids, _ in bags]), minlength=buckets)
    gain = (np.log((1 + len(bags)) / (1 + texts)) / np.log(1 + len(bags))) ** 2
    gain[texts < LEAST_TEXTS] = 0
    rng = np.random.default_rng(seed)
    weight = 0.5 / classes[labels] * len(labels)
    table = rng.normal(0, 0.1, (DIMENSIONS, buckets))
    layer, shift = rng.normal(0, 1.0, (DIMENSIONS, 2)), np.zeros(2)
    values = (table, layer, shift)
    pace, power = [np.zeros_like(value) for value in values], [0.0] * len(values)
    sizes = np.array([len(ids) for ids, _ in bags])
    batches = -(-len(bags) // BATCH)
    epochs = max(EPOCHS, -(-LEAST_STEPS // batches))
    step, steps = 0, epochs * batches + 1
    for _ in range(epochs):
        order = rng.permutation(len(bags))
        for at in range(0, len(order), BATCH):
            rows = order[at : at + BATCH]
            ids = np.concatenate([bags[r][0] for r in rows])
            part = np.concatenate([bags[r][1] for r in rows]) * gain[ids]
            row = np.repeat(np.arange(len(rows)), sizes[rows])
            mean = np.stack([np.bincount(row, table[d][ids] * part, len(rows)) for d in range(DIMENSIONS)], 1)
            wrong = _softmax(mean @ layer + shift)
            wrong[np.arange(len(rows)), labels[rows]] -= 1
            wrong *= weight[rows, None] / len(rows)
            back = wrong @ layer.T
            slope = np.stack([np.bincount(ids, back[row, d] * part, buckets) for d in range(DIMENSIONS)])
            step += 1
            # One scale for a whole matrix: an n-gram that few texts have moves little.
            for i, grad in enumerate((slope, mean.T @ wrong, wrong.sum(axis=0))):
                pace[i] = 0.9 * pace[i] + 0.1 * grad
                power[i] = 0.99 * power[i] + 0.01 * float((grad * grad).mean())
                scale = np.sqrt(power[i] / (1 - 0.99**step)) + 1e-12
                values[i][...] -= RATE * (1 - step / steps) * pace[i] / scale / (1 - 0.9**step)
    return Model((layer[:, 1] - layer[:, 0]) @ table * gain, float(shift[1] - shift[0]))


def fit(
    docs: DataFrame,
    labels: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    label: str = "toxic",
    rows_per_class: int = ROWS_PER_CLASS,
    buckets: int = BUCKETS,
) -> Model:
    """Train on a bounded sample of the labelled documents; see above."""
    valid = labels.filter(F.col(label).isin(0, 1) & F.col(key).isNotNull()).select(
        F.col(key).alias("sampled key"), F.col(label).cast("int").alias("sampled label")
    )
    valid = valid.distinct()
    counts = {row[0]: row[1] for row in valid.groupBy("sampled label").count().collect()}
    total = sum(counts.values())

    def least(frame: DataFrame, *order) -> DataFrame:
        """At most rows_per_class rows of each label."""
        first = frame.filter("`sampled label` = 0").orderBy(*order).limit(rows_per_class)
        return first.unionByName(frame.filter("`sampled label` = 1").orderBy(*order).limit(rows_per_class))

    chosen = least(valid, F.xxhash64(F.col("sampled key").cast("string")), "sampled key")
    # At most twice rows_per_class keys are broadcast.
    sample = docs.select(F.col(key).alias("sampled key"), F.col(text).alias("sampled text")).join(
        F.broadcast(stored(chosen, "chosen")), "sampled key"
    )
    sample = sample.withColumn("row hash", F.xxhash64(F.col("sampled key").cast("string"), "sampled text"))
    # A key may have many rows of text: each key's first different text comes before any key's second.
    names = ["sampled key", "sampled label", "row hash"]
    rows = stored(sample.select(names).distinct(), "sample")
    firsts = rows.groupBy(names[:2]).agg(F.min("row hash").alias("row hash")).withColumn("later", F.lit(0))
    ranked = rows.join(firsts, names, "left").withColumn("later", F.coalesce("later", F.lit(1)))
    picked = stored(least(ranked, "later", "row hash", "sampled key").select(names), "picked")
    sample = sample.join(F.broadcast(picked), names).dropDuplicates(names)

    def run(batches):
        forget()
        for batch in batches:
            for value, answer in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                ids, weights = bag(value, buckets)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([answer], pa.int32()),
                        pa.array([ids.astype(np.int32)], pa.list_(pa.int32())),
                        pa.array([weights.astype(np.float32)], pa.list_(pa.float32())),
                    ],
                    names=["label", "ids", "weights"],
                )

    schema = "label int, ids array<int>, weights array<float>"
    bagged = sample.select("sampled text", "sampled label").mapInArrow(run, schema)
    rows = bagged.withColumn("place", F.xxhash64("ids", "weights", "label")).toArrow()
    bags = [
        (np.asarray(ids.values), np.asarray(weights.values))  # views, no copies
        for ids, weights in zip(rows["ids"], rows["weights"])
    ]
    answers = rows["label"].to_numpy().astype(np.int64)
    order = np.argsort(rows["place"].to_numpy(), kind="stable")
    share = counts.get(1, 0) / total if total else 0.0
    return train([bags[i] for i in order], answers[order], share, buckets)


class Scorer:
    """Scores words with a model, each once."""

    def __init__(self, model: Model):
        self.model = model
        self.forget()

    def forget(self) -> None:
        self.words: dict[str, int] = {}
        self.values: list[float] = []
        self.pieces: dict[str, tuple[int, ...]] = {}

    def number(self, word: str) -> int:
        found = self.words.get(word)
        if found is None:
            weights = self.model.weights
            found = self.words[word] = len(self.values)
            parts = subwords(word, len(weights))
            self.values.append(sum(weights[parts].tolist()) / len(parts))
        return found

    def score(self, texts: list[str | None]) -> list[float]:
        if len(self.pieces) > CACHED_PIECES:
            self.forget()
        result = []
        known, values = self.pieces, self.values
        for text in texts:
            parts = set((text or "").lower().split())
            for piece in parts.difference(known):
                known[piece] = tuple(self.number(word) for word in LETTERS.findall(piece))
            words = set(chain.from_iterable(map(known.__getitem__, parts)))
            # An exact sum, the same in whatever order the words come.
            total = math.fsum(map(values.__getitem__, words))
            odds = total / spread(len(words)) + self.model.intercept
            result.append(1 / (1 + math.exp(-min(max(odds, -700.0), 700.0))))
        return result


def score(docs: DataFrame, model: Model, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """Add the score of label 1, between 0 and 1, of a text column."""
    # Plain values: workers unpickle them without this package.
    shared = docs.sparkSession.sparkContext.broadcast((model.weights, model.intercept))
    digest = (zlib.crc32(model.weights.tobytes()), model.intercept)

    def start():
        scorer = once(("toxicity", digest), lambda: Scorer(Model(*shared.value)))
        return lambda texts: [pa.array(scorer.score(texts), pa.float64())]

    return annotate(docs, [StructField("score", DoubleType())], start, text, keep)


ship(__name__)
