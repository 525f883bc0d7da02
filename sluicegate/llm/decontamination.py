"""Benchmark passages in documents: a set join on rare prefix words with exact verification.

Every ten consecutive words of an item are a window; an item of fewer words, but not none, is one window. A
document contains a window if all its words follow one another there, so each of them must occur, and one prefix
word per window is enough to find it:

1. The words of the items are counted over all documents: the order of rarity.
2. Each window is indexed by its rarest word. Where a document has that word, the window's length and the word's
   place in it fix where the window would begin and end; what doesn't fit into the document is left out.
3. What remains is compared word by word.

Windows come in blocks of bounded number. A block's words and windows are broadcast, whatever the size of the
benchmark; there is one pass over the documents for each block, and no row is moved.

Null texts have no words. Null item ids mark words as hit but don't count as items. Repeated items count once,
repeated documents stay. Without items nothing is hit; without documents the result is empty. Very long texts are rows
like others: memory per task is 4 MB of texts (or one longer text), its words and a block of windows. Other columns
may have any names; those of added columns give way. Words are what ``WORD_TABLE`` leaves between separators.
"""

from __future__ import annotations

import hashlib
from collections import Counter
from itertools import chain

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, LongType, StringType, StructField, StructType

from sluicegate.llm.common import annotate, once, sheltered, ship, slices
from sluicegate.session import stored

WINDOW = 10
BLOCK_WINDOWS = 200_000
# A-Z become a-z; digits, letters and all bytes of other characters stay; the rest separates.
WORD_TABLE = bytes(
    b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256)
)


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode().translate(WORD_TABLE).split()


def windows_of(words: list[bytes], window: int) -> list[bytes]:
    if not words:
        return []
    return [b" ".join(words[i : i + window]) for i in range(max(1, len(words) - window + 1))]


class Index:
    """Windows of a block by their rarest words."""

    def __init__(self, windows: list[tuple[bytes, str | None]], counts: dict[bytes, int]):
        items: dict[bytes, set[str]] = {}
        for text, item in windows:
            items.setdefault(text, set())
            if item is not None:
                items[text].add(item)
        self.by_word: dict[bytes, list[tuple[int, list[bytes], set[str]]]] = {}
        for text, owners in items.items():
            words = text.split()
            place = min(range(len(words)), key=lambda i: (counts.get(words[i], 0), words[i], i))
            self.by_word.setdefault(words[place], []).append((place, words, owners))

    def find(self, words: list[bytes]) -> tuple[list[tuple[int, int]], set[str]]:
        """Word intervals inside windows, apart and in order, and the items of these windows."""
        index, items = self.by_word, set()
        if index.keys().isdisjoint(words):
            return [], items
        found = []
        for at, word in enumerate(words):
            for place, window, owners in index.get(word, ()):
                begin = at - place
                end = begin + len(window)
                if begin >= 0 and end <= len(words) and words[begin:end] == window:
                    found.append((begin, end))
                    items |= owners
        found.sort()
        merged: list[tuple[int, int]] = []
        for begin, end in found:
            if merged and begin <= merged[-1][1]:
                merged[-1] = (merged[-1][0], max(end, merged[-1][1]))
            else:
                merged.append((begin, end))
        return merged, items


def item_windows(benchmark: DataFrame, item: str, text: str, window: int) -> DataFrame:
    """item, window: every different pair, as a stored table."""

    def run(batches):
        for batch in batches:
            for key, value in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                made = list(set(windows_of(words_of(value), window)))
                yield pa.RecordBatch.from_arrays(
                    [pa.array([key] * len(made), pa.string()), pa.array(made, pa.binary())],
                    names=["item", "window"],
                )

    items = benchmark.select(F.col(item).cast("string"), F.col(text))
    return stored(items.mapInArrow(run, "item string, window binary").distinct(), "windows")


def word_counts(docs: DataFrame, text: str, vocabulary: set[bytes]) -> dict[bytes, int]:
    """How often the words of a block, of bounded number, occur in all documents."""
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def run(batches):
        counts: Counter[bytes] = Counter()
        known = None
        for batch in batches:
            known = known or shared.value.__contains__
            for lo, hi in slices(batch.column(0)):
                texts = batch.column(0).slice(lo, hi - lo).to_pylist()
                counts.update(filter(known, chain.from_iterable(map(words_of, texts))))
        yield pa.RecordBatch.from_arrays(
            [pa.array(list(counts), pa.binary()), pa.array(list(counts.values()), pa.int64())],
            names=["word", "n"],
        )

    counted = docs.select(text).mapInArrow(run, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))
    table = counted.toArrow()
    return dict(zip(table["word"].to_pylist(), table["n"].to_pylist()))


def find_benchmark(
    docs: DataFrame,
    benchmark: DataFrame,
    text: str = "text",
    item: str = "item_id",
    item_text: str = "text",
    keep: list[str] | None = None,
    window: int = WINDOW,
    block_windows: int = BLOCK_WINDOWS,
) -> DataFrame:
    """Add n_words, n_hit, items (the ids as sorted strings), hit_spans (word intervals) and contaminated."""

    def work(frame: DataFrame, names: dict[str, str]) -> DataFrame:
        kept = [names[c] for c in (docs.columns if keep is None else keep)]
        return _find_benchmark(frame, benchmark, names[text], item, item_text, kept, window, block_windows)

    return sheltered(docs, work, keep, (text,))


def _find_benchmark(
    docs: DataFrame,
    benchmark: DataFrame,
    text: str,
    item: str,
    item_text: str,
    names: list[str],
    window: int,
    block_windows: int,
) -> DataFrame:
    spark = docs.sparkSession
    windows = item_windows(benchmark, item, item_text, window)
    blocks = max(1, -(-windows.count() // block_windows))
    span = StructType([StructField("begin", IntegerType()), StructField("end", IntegerType())])
    span_kind = pa.list_(pa.struct([("begin", pa.int32()), ("end", pa.int32())]))
    source = "text to search"
    frame = docs.select(*[f"`{c}`" for c in names], F.col(f"`{text}`").alias(source))
    for block in range(blocks):
        mine = F.pmod(F.xxhash64("item", "window"), F.lit(blocks)) == block
        table = windows.filter(mine).toArrow().sort_by([("window", "ascending"), ("item", "ascending")])
        pairs = list(zip(table["window"].to_pylist(), table["item"].to_pylist()))
        vocabulary = {word for text_of, _ in pairs for word in text_of.split()}
        counts = word_counts(docs, f"`{text}`", vocabulary)
        shared = spark.sparkContext.broadcast((pairs, counts))
        digest = hashlib.sha256(repr((pairs, sorted(counts.items()))).encode()).hexdigest()

        def start(shared=shared, digest=digest):
            index = once(("benchmark", digest), lambda: Index(*shared.value))

            def work(texts):
                words = [words_of(value) for value in texts]
                found = [index.find(value) for value in words]
                return [
                    pa.array([len(value) for value in words], pa.int64()),
                    pa.array([[{"begin": a, "end": b} for a, b in spans] for spans, _ in found], span_kind),
                    pa.array([sorted(items) for _, items in found], pa.list_(pa.string())),
                ]

            return work

        fields = [
            StructField("n_words", LongType()),
            StructField(f"spans of block {block}", ArrayType(span)),
            StructField(f"items of block {block}", ArrayType(StringType())),
        ]
        frame = annotate(frame, fields, start, source, [c for c in frame.columns if c != source or block + 1 < blocks])
    spans = F.array_sort(F.flatten(F.array(*[f"spans of block {b}" for b in range(blocks)])))
    items = F.array_sort(F.array_distinct(F.flatten(F.array(*[f"items of block {b}" for b in range(blocks)]))))
    hit = F.aggregate(
        "hit_spans",
        F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).alias("upto")),
        lambda state, x: F.struct(
            (state.n + F.greatest(F.lit(0), x.end - F.greatest(x.begin, state.upto))).alias("n"),
            F.greatest(state.upto, x.end).alias("upto"),
        ),
        lambda state: state.n,
    )
    return (
        frame.select(*[f"`{c}`" for c in names], "n_words", spans.alias("hit_spans"), items.alias("items"))
        .withColumn("n_hit", hit)
        .withColumn("contaminated", F.col("n_hit") > 0)
    )


ship(__name__)
