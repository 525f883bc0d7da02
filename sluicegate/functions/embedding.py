"""Text embedding by feature hashing, and vector similarity.

The default embedder counts words into a fixed number of buckets. Only bucket numbers travel;
vectors are formed batch-wise where they are used. Any other encoder fits by producing vectors.
"""

from __future__ import annotations

import hashlib
from array import array
from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.feature import IDF, HashingTF, Normalizer
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import arrow_udf

from sluicegate.functions import text as tx
from sluicegate.functions.portable import portable

DIMENSIONS = 512
ROWS_PER_BLOCK = 4096
# Texts that a worker has as Python strings at a time, and different words whose buckets it remembers.
TEXTS_PER_STEP = 512
REMEMBERED = 200_000


def word_buckets(text: Column, dimensions: int = DIMENSIONS) -> Column:
    """Bucket numbers of a text's words: the leading 32 bits of their md5, reduced."""
    return F.transform(
        tx.words(F.lower(text)),
        lambda word: (
            F.conv(F.substring(F.md5(word), 1, 8), 16, 10).cast("bigint") % dimensions
        ).cast("int"),
    )


@portable
def unit_rows(lists: pa.Array, kind: str, dimensions: int) -> np.ndarray:
    """One unit vector per list: 'bag' lists hold bucket numbers, 'dense' lists the vector itself."""
    values = lists.flatten().to_numpy(zero_copy_only=False)
    if kind == "bag":
        sizes = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False)
        row = np.repeat(np.arange(len(lists)), sizes)
        matrix = np.bincount(
            row * dimensions + values, minlength=len(lists) * dimensions
        ).astype(np.float64).reshape(len(lists), dimensions)
    else:
        matrix = values.astype(np.float64).reshape(len(lists), dimensions)
    norms = np.linalg.norm(matrix, axis=1, keepdims=True)
    return np.divide(matrix, norms, out=np.zeros_like(matrix), where=norms > 0)


@portable
def blocks(lists: pa.Array) -> list[pa.Array]:
    return [lists.slice(at, ROWS_PER_BLOCK) for at in range(0, len(lists), ROWS_PER_BLOCK)]


@portable
def text_buckets(texts: pa.Array, known: dict[str, int], dimensions: int = DIMENSIONS) -> pa.Array:
    """``word_buckets`` of lower-case texts; ``known`` keeps the buckets of words from one call to the next."""
    if len(known) > REMEMBERED:
        known.clear()
    numbers, offsets, nulls = array("i"), [0], []
    for at in range(0, len(texts), TEXTS_PER_STEP):
        for text in texts.slice(at, TEXTS_PER_STEP).to_pylist():
            # Python splits at the characters of ``text.SPACE``.
            words = () if text is None else text.split()
            buckets = list(map(known.get, words))
            if None in buckets:
                for place, word in enumerate(words):
                    if buckets[place] is None:
                        digest = hashlib.md5(word.encode()).digest()
                        buckets[place] = known[word] = int.from_bytes(digest[:4], "big") % dimensions
            numbers.extend(buckets)
            nulls.append(text is None)
            offsets.append(len(numbers))
    values = pa.array(np.array(numbers, dtype=np.int32))
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), values, mask=pa.array(nulls, pa.bool_()))


def _lowered(texts: str) -> Column:
    return tx.pinned(F.transform(texts, lambda text: F.lower(text)))


def text_cosines() -> Callable[[pa.Array], pa.Array]:
    """A function for workers: of each list of texts the cosines of all of them with the first one, in one array."""
    known: dict[str, int] = {}

    @portable
    def cosines(lists: pa.Array) -> pa.Array:
        found = [np.zeros(0)]
        for at in range(0, len(lists), TEXTS_PER_STEP):
            part = lists.slice(at, TEXTS_PER_STEP)
            number = part.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
            lowered = [text and text.lower() for text in part.flatten().to_pylist()]
            bags = unit_rows(text_buckets(pa.array(lowered, pa.string()), known), "bag", DIMENSIONS)
            first = np.repeat(np.cumsum(number) - number, number)
            found.append(np.einsum("ij,ij->i", bags, bags[first]))
        return pa.array(np.concatenate(found))

    return cosines


class WordBuckets:
    """The default encoder: hashed word counts. A task hashes each different word once."""

    kind, dimensions = "bag", DIMENSIONS

    def encode(self, frame: DataFrame, texts: str, out: str) -> DataFrame:
        """Add an array of features, one per text of the array column ``texts``."""
        known: dict[str, int] = {}

        @arrow_udf(T.ArrayType(T.ArrayType(T.IntegerType())))
        @portable
        def encoded(lists: pa.Array) -> pa.Array:
            sizes = lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
            offsets = np.concatenate([[0], np.cumsum(sizes)])
            return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), text_buckets(lists.flatten(), known))

        coded = frame.withColumn("lowered_", _lowered(texts)).withColumn(out, tx.pinned(encoded("lowered_")))
        return coded.drop("lowered_")

    def add_cosines(self, frame: DataFrame, texts: str, out: str) -> DataFrame:
        """Add the cosines of all texts of the array column ``texts`` with the first one; no features move."""
        known: dict[str, int] = {}

        @arrow_udf(T.ArrayType(T.DoubleType()))
        @portable
        def cosines(lists: pa.Array) -> pa.Array:
            found = [np.zeros(0)]
            for at in range(0, len(lists), TEXTS_PER_STEP):
                part = lists.slice(at, TEXTS_PER_STEP)
                number = part.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
                bags = unit_rows(text_buckets(part.flatten(), known), "bag", DIMENSIONS)
                first = np.repeat(np.cumsum(number) - number, number)
                found.append(np.einsum("ij,ij->i", bags, bags[first]))
            sizes = lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
            offsets = np.concatenate([[0], np.cumsum(sizes)])
            return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(np.concatenate(found)))

        coded = frame.withColumn("lowered_", _lowered(texts)).withColumn(out, tx.pinned(cosines("lowered_")))
        return coded.drop("lowered_")


class BatchEncoder:
    """Any model that turns a list of texts into a matrix, called batch by batch."""

    kind = "dense"

    def __init__(self, predict: Callable[[list[str]], np.ndarray], dimensions: int):
        self.predict, self.dimensions = predict, dimensions

    def encode(self, frame: DataFrame, texts: str, out: str) -> DataFrame:
        predict, dimensions, size = self.predict, self.dimensions, ROWS_PER_BLOCK

        @arrow_udf(T.ArrayType(T.ArrayType(T.FloatType())))
        def encoded(lists: pa.Array) -> pa.Array:
            flat = lists.flatten()
            parts = [np.zeros((0, dimensions), np.float32)]
            parts += [
                np.asarray(predict(flat.slice(i, size).to_pylist()), np.float32) for i in range(0, len(flat), size)
            ]
            values = np.concatenate(parts)
            starts = pa.array(np.arange(len(flat) + 1, dtype=np.int32) * dimensions)
            vectors = pa.ListArray.from_arrays(starts, pa.array(values.ravel()))
            sizes = lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
            offsets = np.concatenate([[0], np.cumsum(sizes)])
            return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), vectors)

        whole = F.when(F.size(texts) >= 0, F.col(texts))
        return frame.withColumn(out, encoded(whole))


def fit_tfidf(texts: DataFrame, text: str = "text", features: int = DIMENSIONS) -> PipelineModel:
    """An encoder fitted on a corpus: hashed word counts, weighted by rarity, of length one."""
    stages = [
        HashingTF(inputCol="words_", outputCol="counts_", numFeatures=features),
        IDF(inputCol="counts_", outputCol="weighted_"),
        Normalizer(inputCol="weighted_", outputCol="vector_"),
    ]
    return Pipeline(stages=stages).fit(texts.withColumn("words_", tx.words(F.lower(text))))


def encode_tfidf(frame: DataFrame, model: PipelineModel, text: str, out: str = "embedding") -> DataFrame:
    """Add a dense vector of floats."""
    encoded = model.transform(frame.withColumn("words_", tx.words(F.lower(text))))
    return encoded.withColumn(out, vector_to_array("vector_", "float32")).drop(
        "words_", "counts_", "weighted_", "vector_"
    )


def text_cosine(left: Column, right: Column) -> Column:
    """Cosine of two texts' hashed word counts."""
    return bag_cosine(word_buckets(left), word_buckets(right))


def dot(left: Column, right: Column) -> Column:
    """Dot product of two float arrays inside the JVM."""
    return F.aggregate(
        F.zip_with(left, right, lambda a, b: a.cast("double") * b.cast("double")),
        F.lit(0.0),
        lambda total, value: total + value,
    )


def unit(vector: Column) -> Column:
    """A vector scaled to length one."""
    return tx.let(
        F.sqrt(dot(vector, vector)),
        lambda norm: F.transform(vector, lambda x: F.when(norm > 0, x / norm).otherwise(F.lit(0.0))),
    )


@arrow_udf(T.DoubleType())
@portable
def bag_cosine(left: pa.Array, right: pa.Array) -> pa.Array:
    """Cosine of two bags per row."""
    found = [np.zeros(0)]
    for a, b in zip(blocks(left), blocks(right)):
        rows = unit_rows(a, "bag", DIMENSIONS), unit_rows(b, "bag", DIMENSIONS)
        found.append(np.einsum("ij,ij->i", *rows))
    return pa.array(np.concatenate(found))


@arrow_udf(T.ArrayType(T.DoubleType()))
@portable
def cosines_with_first(lists: pa.Array) -> pa.Array:
    """Of each array of bags the cosines of all of them with the first one."""
    found = [np.zeros(0)]
    for part in blocks(lists):
        sizes = part.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
        flat = part.flatten()
        at = 0
        # So many arrays at a time that their bags fill about a block.
        for rows in np.array_split(sizes, -(-len(flat) // ROWS_PER_BLOCK) or 1):
            bags = unit_rows(flat.slice(at, int(rows.sum())), "bag", DIMENSIONS)
            first = np.repeat(np.cumsum(rows) - rows, rows)
            found.append(np.einsum("ij,ij->i", bags, bags[first]))
            at += int(rows.sum())
    sizes = lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
    offsets = np.concatenate([[0], np.cumsum(sizes)])
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(np.concatenate(found)))
