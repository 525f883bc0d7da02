"""Linear classifiers over hashed words: training by epochs with the best one kept, and scoring in the row.

Words fall into ``features`` buckets by md5. *Training* goes through the rows in mini-batches: a row's batch follows
from its key, and an epoch takes the batches in an order of its own. The rows are encoded once and stored in a folder
per batch, so a step reads its own rows only. Tasks add up the gradients of their rows; one number per bucket goes
to the driver, which moves the weights, and the weights go out with the next step. Gradients are whole numbers of
2 ** -24: their sum has no rounding, so the model is the same under any partitioning and after any retry. After each
epoch the model is judged on the held-out rows, and the one with the best F1 of class 1 stays.

*Scoring* sums whole millionths, exactly, over every window of a text's words (see ``classifier``). It runs on Arrow
batches of bucket numbers where the texts lie; nothing is shuffled.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import arrow_udf

from sluicegate import fixed_values as fv
from sluicegate.functions import text as tx
from sluicegate.functions.portable import portable
from sluicegate.operators import classifier as cl
from sluicegate.session import stored

FEATURES = 1 << 16
EPOCHS = 5
BATCHES = 8
RATE = 0.05
DECAY = 1e-4
# How much of the earlier gradients, and of their size, stays with each step.
PACE, POWER = 0.8, 0.95
# Gradients are whole numbers of this part.
GRAIN = 1 << 24


def word_ids(text: Column, features: int) -> Column:
    """Bucket numbers of all words, as a classifier sees them."""
    return F.transform(
        cl.model_words(text),
        lambda word: (F.conv(F.substring(F.md5(word), 1, 8), 16, 10).cast("bigint") % features).cast("int"),
    )


@portable
def largest_sums(ids: pa.Array, millionths: np.ndarray, size: int) -> np.ndarray:
    """Of each list of buckets the largest sum of weights over all windows of ``size``, of all if they are fewer."""
    values = millionths[ids.flatten().to_numpy(zero_copy_only=False)]
    so_far = np.concatenate([[0], np.cumsum(values)])
    sizes = ids.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
    ends = np.cumsum(sizes)
    starts = ends - sizes
    sums = so_far[ends] - so_far[starts]
    for row in np.flatnonzero(sizes > size).tolist():
        part = so_far[starts[row] : ends[row] + 1]
        sums[row] = (part[size:] - part[:-size]).max()
    return sums


class HashedScorer:
    """Logistic score of a linear model over hashed words, with weights in millionths."""

    def __init__(self, millionths: np.ndarray, intercept: float):
        self.millionths, self.intercept = np.asarray(millionths, dtype=np.int64), float(intercept)

    in_row = False

    @property
    def features(self) -> int:
        return len(self.millionths)

    def add_risks(self, frame: DataFrame, texts: str, out: str) -> DataFrame:
        """Add an array of risks, one per text of an array column."""
        # One number per bucket, whatever the corpus.
        shared, size = frame.sparkSession.sparkContext.broadcast(self.millionths), fv.MODEL_TOKENS

        @arrow_udf(T.ArrayType(T.LongType()))
        @portable
        def sums(lists: pa.Array) -> pa.Array:
            number = lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
            offsets = np.concatenate([[0], np.cumsum(number)]).astype(np.int32)
            found = largest_sums(lists.flatten(), shared.value, size)
            return pa.ListArray.from_arrays(pa.array(offsets), pa.array(found))

        ids = F.transform(texts, lambda text: F.coalesce(word_ids(text, self.features), F.array().cast("array<int>")))
        coded = frame.withColumn("ids_", tx.pinned(ids)).withColumn("sums_", tx.pinned(sums("ids_")))
        risks = F.transform("sums_", lambda n: 1.0 / (1.0 + F.exp(-(n / F.lit(1e6) + self.intercept))))
        return coded.withColumn(out, risks).drop("ids_", "sums_")

    def __call__(self, frame: DataFrame, text: str) -> DataFrame:
        risks = self.add_risks(frame.withColumn("texts_", F.array(text)), "texts_", "risks_")
        risk = F.when(F.col(text).isNotNull(), F.get("risks_", F.lit(0)))
        return risks.withColumn("risk", risk).drop("texts_", "risks_")

    def token_weights(self, tokens: DataFrame) -> DataFrame:
        """A word's weight is what it adds to the margin."""
        shared = tokens.sparkSession.sparkContext.broadcast(self.millionths)

        @arrow_udf(T.DoubleType())
        @portable
        def weight(ids: pa.Array) -> pa.Array:
            return pa.array(shared.value[ids.to_numpy(zero_copy_only=False)] / 1e6)

        bucket = F.get(word_ids(F.col("word"), self.features), F.lit(0))
        return tokens.withColumn("bucket_", tx.pinned(bucket)).withColumn("weight", weight("bucket_")).drop("bucket_")

    def save(self, spark: SparkSession, path: str) -> None:
        used = np.flatnonzero(self.millionths)
        rows = list(zip(used.tolist(), self.millionths[used].tolist()))
        # The intercept and the number of buckets stand below the buckets.
        rows += [(-1, round(self.intercept * 1e6)), (-2, self.features)]
        spark.createDataFrame(rows, "bucket int, millionths long").coalesce(1).write.mode("overwrite").parquet(path)

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> HashedScorer:
        rows = dict(map(tuple, spark.read.parquet(path).collect()))  # at most a row per bucket
        millionths = np.zeros(rows.pop(-2), dtype=np.int64)
        intercept = rows.pop(-1) / 1e6
        millionths[list(rows)] = list(rows.values())
        return cls(millionths, intercept)


def fit_shares(rows: DataFrame, features: int = FEATURES, scale: float = 4.0, intercept: float = -1.0) -> HashedScorer:
    """A model in one pass: a bucket weighs by the share of class 1 that has it, less that of class 0."""
    ids = F.array_distinct(word_ids(F.col("text"), features))
    n = {row["label"]: row["count"] for row in rows.groupBy("label").count().collect()}  # a row per class
    counted = rows.select("label", F.explode(ids).alias("bucket")).groupBy("bucket").agg(
        *[F.count(F.when(F.col("label") == k, 1)).alias(f"n{k}") for k in (0, 1)]
    )
    share = F.col("n1") / F.lit(float(max(n.get(1, 0), 1))) - F.col("n0") / F.lit(float(max(n.get(0, 0), 1)))
    # A bucket that both classes have alike says nothing.
    table = counted.select("bucket", F.round(share * scale, 6).alias("weight")).toArrow()
    millionths = np.zeros(features, dtype=np.int64)
    millionths[table["bucket"].to_numpy()] = np.rint(table["weight"].to_numpy() * 1e6).astype(np.int64)
    return HashedScorer(millionths, intercept)


# -- training by epochs -----------------------------------------------------


def encoded_rows(rows: DataFrame, key: str, features: int, batches: int, seed: int) -> DataFrame:
    """label, class_weight, ids, batch of rows (key, text, label), stored in a folder per batch."""
    weights = cl.class_weights(rows).select("label", F.col("weight").alias("class_weight"))  # a row per class
    batch = F.pmod(F.xxhash64(F.lit(seed), F.col(key).cast("string")), F.lit(batches)).cast("int")
    coded = rows.select("label", word_ids(F.col("text"), features).alias("ids"), batch.alias("batch"))
    return stored(coded.join(F.broadcast(weights), "label"), "encoded", ("batch",))


def rarity(coded: DataFrame, features: int) -> np.ndarray:
    """The logarithm of how rare a bucket is among the rows, 0 for one that none has."""
    rows = coded.count()
    seen = coded.select(F.explode(F.array_distinct("ids")).alias("bucket")).groupBy("bucket").count().toArrow()
    result = np.zeros(features)
    result[seen["bucket"].to_numpy()] = np.log((rows + 1) / (seen["count"].to_numpy() + 1))
    return result


@portable
def row_entries(ids: pa.Array, features: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, bucket and count of the different buckets of each row, in order."""
    sizes = ids.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
    row = np.repeat(np.arange(len(ids)), sizes)
    found, counts = np.unique(row * features + ids.flatten().to_numpy(zero_copy_only=False), return_counts=True)
    return found // features, found % features, counts


def gradient(coded: DataFrame, state: tuple[np.ndarray, np.ndarray, float], features: int) -> tuple[np.ndarray, int]:
    """The sum of the rows' gradients, the intercept's last, in grains; and the number of rows."""
    shared = coded.sparkSession.sparkContext.broadcast(state)

    def run(batches):
        weights, rare, intercept = shared.value
        total, rows = np.zeros(features + 1, dtype=np.int64), 0
        for batch in batches:
            label, weight = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            row, bucket, count = row_entries(batch.column(2), features)
            value = count * rare[bucket]
            margin = np.bincount(row, value * weights[bucket], minlength=len(label)) + intercept
            wrong = (1 / (1 + np.exp(-np.clip(margin, -500, 500))) - label) * weight
            np.add.at(total, bucket, np.rint(wrong[row] * value * GRAIN).astype(np.int64))
            total[features] += int(np.rint(wrong * GRAIN).astype(np.int64).sum())
            rows += len(label)
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.append(used, -1).astype(np.int32)), pa.array(np.append(total[used], rows))],
            names=["bucket", "grains"],
        )

    parts = coded.select("label", "class_weight", "ids").mapInArrow(run, "bucket int, grains long")
    table = parts.groupBy("bucket").agg(F.sum("grains").alias("grains")).toArrow()  # a row per bucket
    result, rows = np.zeros(features + 1, dtype=np.int64), 0
    for bucket, grains in zip(table["bucket"].to_pylist(), table["grains"].to_pylist()):
        if bucket < 0:
            rows = grains
        else:
            result[bucket] = grains
    return result, rows


def train_epochs(
    rows: DataFrame,
    held_out: DataFrame,
    key: str = "doc_id",
    epochs: int = EPOCHS,
    batches: int = BATCHES,
    features: int = FEATURES,
    rate: float = RATE,
    decay: float = DECAY,
    seed: int = 42,
    start: HashedScorer | None = None,
) -> tuple[HashedScorer, list[dict]]:
    """The model of the epoch with the best F1 on the held-out rows, and the quality after every epoch.

    Both frames have text and label, ``rows`` a key, too. Of equal epochs the first one stays. ``start`` has weights to
    go on from. All weights move on one scale, with the mean of the latest gradients: a bucket that few texts have
    moves little.
    """
    coded = encoded_rows(rows, key, features, batches, seed)
    rare = rarity(coded, features)
    judged = stored(held_out.select("text", "label"), "held-out")
    weights, intercept = np.zeros(features), 0.0
    if start is not None:
        known = np.where(rare > 0, rare, 1)
        weights, intercept = np.where(rare > 0, start.millionths / 1e6 / known, 0), start.intercept
    pace, power, steps = np.zeros(features + 1), 0.0, 0
    best, history = None, []
    for epoch in range(1, epochs + 1):
        for batch in np.random.default_rng([seed, epoch]).permutation(batches).tolist():
            grains, n = gradient(coded.filter(F.col("batch") == batch), (weights, rare, intercept), features)
            if not n:
                continue
            slope = grains / GRAIN / n
            slope[:features] += decay * weights
            steps += 1
            pace = PACE * pace + (1 - PACE) * slope
            power = POWER * power + (1 - POWER) * float((slope * slope).sum())
            step = rate * pace / (1 - PACE**steps) / (math.sqrt(power / (1 - POWER**steps)) + 1e-12)
            weights, intercept = weights - step[:features], intercept - step[features]
        millionths = np.rint(weights * rare * 1e6).astype(np.int64)
        scorer = HashedScorer(millionths, round(intercept, 6))
        predicted = (F.col("risk") > 0.5).cast("int")
        quality = cl.classification_metrics(scorer(judged, "text"), F.col("label"), predicted).first().asDict()
        history.append({"epoch": epoch, **quality})
        if best is None or quality["f1"] > best[0]:
            best = (quality["f1"], epoch, scorer)
    for row in history:
        row["kept"] = row["epoch"] == best[1]
    return best[2], history
