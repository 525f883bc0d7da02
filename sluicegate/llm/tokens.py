"""Token counts of whole texts; huge texts are encoded in overlapping chunks that resynchronise.

A text of up to ``chunk`` characters is encoded where it lies, without a shuffle. A longer one is cut
into overlapping chunks that spread over the cluster, and each chunk is encoded with offsets. Two
neighbouring chunks are spliced at a *stable common boundary* in their overlap:

- Pre-tokenisation works from left to right and looks a few characters ahead. From a place on where both
  encodings start a word, both go on alike: what the later chunk has made of its own first characters no
  longer matters, and the earlier chunk is in step with the whole text by induction.
- A boundary within ``MARGIN`` characters of the earlier chunk's end isn't trusted: what follows the chunk
  could still change it.

Where an overlap has no such boundary (a run of a hundred thousand letters is one word), the text is cut
again with twice the chunk and four times the overlap, in the end whole. Chunks belong to a text's SHA-256,
so a retried task repeats them, and copies of a text count once where chunks meet.

Null texts count as empty: 0 bytes, 0 tokens. Repeated rows stay, and a text that very many rows have is counted once
and joined where they lie. Empty tables give empty results. Other columns may have any names; one called n_bytes or
n_tokens gives way. Memory per task is the tokenizer, 4 MB of
texts (or one longer text) and a bounded cache.
"""

from __future__ import annotations

import hashlib
import json

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField
from tokenizers import Tokenizer

from sluicegate.llm.bpe import pieces
from sluicegate.llm.common import annotate, join_hot, once, sheltered, ship
from sluicegate.session import stored

CHUNK = 32_768
OVERLAP = 512
# Longer than any look-ahead of the pre-tokenizer; special tokens are added to it.
MARGIN = 16
CACHED_PIECES = 300_000
# Encodings that are in memory at a time.
PIECES_AT_A_TIME = 5_000
CHUNK_SCHEMA = "text_key string, chunk long, begin long, last boolean, text string"
SUMMARY_SCHEMA = (
    "text_key string, chunk long, last boolean, n_tokens long, "
    "left_starts array<long>, left_tokens array<long>, right_starts array<long>, right_tokens array<long>"
)


class Counter:
    """A tokenizer of the library, and the counts of the pieces it has seen."""

    def __init__(self, content: str):
        spec = json.loads(content)
        splitter = spec["pre_tokenizer"] or {}
        if splitter.get("type") != "ByteLevel" or splitter["add_prefix_space"] or any(
            spec[part] for part in ("normalizer", "post_processor")
        ):
            raise ValueError("only byte-level tokenizers without prefixes and other steps are supported")
        self.tokenizer = Tokenizer.from_str(content)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.margin = MARGIN + max([len(t["content"]) for t in spec["added_tokens"]], default=0)
        self.cache: dict[str, int] = {}

    def count(self, texts: list[str]) -> list[int]:
        """Tokens of whole texts. Every different piece between clear spaces is encoded once."""
        cut = [pieces(text) for text in texts]
        if len(self.cache) > CACHED_PIECES:
            self.cache = {}
        new = list({piece for parts in cut for piece in parts} - self.cache.keys())
        for at in range(0, len(new), PIECES_AT_A_TIME):
            some = new[at : at + PIECES_AT_A_TIME]
            encoded = self.tokenizer.encode_batch_fast(some, add_special_tokens=False)
            self.cache.update(zip(some, [len(e) for e in encoded]))
        known = self.cache.__getitem__
        return [sum(map(known, parts)) for parts in cut]

    def word_starts(self, text: str) -> tuple[int, list[int], list[int]]:
        """The number of tokens, the places where words start, and the tokens before each of them."""
        encoding = self.tokenizer.encode(text, add_special_tokens=False)
        places, tokens, last = [], [], None
        words, offsets = encoding.word_ids, encoding.offsets
        for number, word in enumerate(words):
            if word != last or word is None:
                places.append(offsets[number][0])
                tokens.append(number)
            last = word
        return len(words), places, tokens


def cut(text: str, chunk: int, overlap: int) -> list[tuple[int, str]]:
    """Begin and text of chunks; each one but the first repeats the last characters of the one before."""
    step = chunk - overlap
    begins = range(0, max(1, len(text) - overlap), step)
    return [(begin, text[begin : begin + chunk]) for begin in begins]


def _read(path: str) -> tuple[str, str]:
    with open(path, encoding="utf-8") as file:
        content = file.read()
    return content, hashlib.sha256(content.encode()).hexdigest()


def _chunks(texts: DataFrame, chunk: int, overlap: int) -> DataFrame:
    """Chunks of a column ``text``, with the text's key."""

    def run(batches):
        for batch in batches:
            for key, text in zip(*(column.to_pylist() for column in batch.columns)):
                parts = cut(text, chunk, overlap)
                for lo in range(0, len(parts), 64):
                    rows = [
                        (key, n, begin, n + 1 == len(parts), part)
                        for n, (begin, part) in enumerate(parts[lo : lo + 64], lo)
                    ]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(column) for column in zip(*rows)],
                        names=["text_key", "chunk", "begin", "last", "text"],
                    )

    return texts.select("text_key", "text").mapInArrow(run, CHUNK_SCHEMA)


def _summaries(chunks: DataFrame, counter, overlap: int) -> DataFrame:
    """Of each chunk the tokens, and the word starts in its two overlaps with the tokens before them."""

    def run(batches):
        names = ("text_key", "chunk", "last", "n_tokens", "left_starts", "left_tokens", "right_starts", "right_tokens")
        kinds = [pa.string(), pa.int64(), pa.bool_(), pa.int64(), *[pa.list_(pa.int64())] * 4]
        for batch in batches:
            encoder = counter()
            for row in batch.to_pylist():
                begin, text = row["begin"], row["text"]
                total, places, tokens = encoder.word_starts(text)
                trusted = len(text) - encoder.margin
                left = [(begin + p, t) for p, t in zip(places, tokens) if p < overlap]
                right = [
                    (begin + p, t) for p, t in zip(places, tokens) if len(text) - overlap <= p <= trusted
                ]
                values = [
                    row["text_key"], row["chunk"], row["last"], total,
                    [p for p, _ in left], [t for _, t in left], [p for p, _ in right], [t for _, t in right],
                ]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([v], kind) for v, kind in zip(values, kinds)], names=list(names)
                )

    return chunks.mapInArrow(run, SUMMARY_SCHEMA)


def splice(summaries: DataFrame) -> DataFrame:
    """text_key, n_tokens of each text; null where two neighbours have no stable common boundary.

    A chunk counts from the boundary it shares with the chunk before up to the one it shares with the
    next. A row per chunk moves here, no text.
    """
    # Stored: the join reads both sides from it, and no chunk is encoded for each of them.
    once_each = stored(summaries.dropDuplicates(["text_key", "chunk"]), "summaries")
    following = once_each.select(
        "text_key",
        (F.col("chunk") - 1).alias("chunk"),
        F.col("left_starts").alias("next_starts"),
        F.col("left_tokens").alias("next_tokens"),
    )
    meeting = F.expr("array_min(array_intersect(right_starts, next_starts))")
    met = once_each.join(following, ["text_key", "chunk"], "left").withColumn("place", meeting)
    until = F.expr("if(last, n_tokens, right_tokens[array_position(right_starts, place) - 1])")
    skipped = F.expr("if(last, 0, next_tokens[array_position(next_starts, place) - 1])")
    parts = met.select("text_key", until.alias("until"), skipped.alias("skipped"))
    return parts.groupBy("text_key").agg(
        F.when(
            F.count("*") == F.count(F.col("until") + F.col("skipped")), F.sum(F.col("until") - F.col("skipped"))
        ).alias("n_tokens")
    )


def count_tokens(
    docs: DataFrame,
    path: str,
    text: str = "text",
    keep: list[str] | None = None,
    chunk: int = CHUNK,
    overlap: int = OVERLAP,
) -> DataFrame:
    """Add n_bytes (UTF-8) and n_tokens of a text column, as the tokenizer at ``path`` counts them."""

    def work(frame: DataFrame, names: dict[str, str]) -> DataFrame:
        return _count_tokens(
            frame, path, names[text], [names[c] for c in (docs.columns if keep is None else keep)], chunk, overlap
        )

    return sheltered(docs, work, keep, (text,))


def _count_tokens(docs: DataFrame, path: str, text: str, names: list[str], chunk: int, overlap: int) -> DataFrame:
    content, digest = _read(path)
    shared = docs.sparkSession.sparkContext.broadcast(content)  # a vocabulary file, of fixed size

    def counter() -> Counter:
        return once(("token_counter", digest), lambda: Counter(shared.value))

    def start():
        encoder = counter()

        def work(texts):
            values = [value or "" for value in texts]
            return [
                pa.array([len(value.encode()) for value in values], pa.int64()),
                pa.array(encoder.count(values), pa.int64()),
            ]

        return work

    source = F.col(f"`{text}`")
    is_huge = F.coalesce(F.length(source) > chunk, F.lit(False))
    fields = [StructField("n_bytes", LongType()), StructField("n_tokens", LongType())]
    counted = annotate(docs.filter(~is_huge), fields, start, text, names)
    texts = docs.filter(is_huge).select(
        F.sha2(source.cast("binary"), 256).alias("text_key"), source.alias("text")
    )
    spliced = spliced_counts(texts, counter, chunk, overlap)
    added = docs.filter(is_huge).select(
        *[f"`{c}`" for c in names],
        F.octet_length(source).cast("long").alias("n_bytes"),
        F.sha2(source.cast("binary"), 256).alias("key of the text"),
    )
    rows = added.groupBy("key of the text").agg(F.count("*").alias("rows of the text"))
    found = spliced.withColumnRenamed("text_key", "key of the text").join(rows, "key of the text")
    added = join_hot(added, stored(found, "counts"), "key of the text", "rows of the text")
    return counted.unionByName(added.drop("key of the text", "rows of the text"))


def spliced_counts(texts: DataFrame, counter, chunk: int, overlap: int) -> DataFrame:
    """text_key, n_tokens of texts with their keys, each round with larger chunks for those that failed."""
    parts = max(12, int(texts.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    result, waiting = None, texts
    while True:
        chunks = _chunks(waiting, chunk, overlap).repartition(parts, "text_key", "chunk")
        counts = stored(splice(_summaries(chunks, counter, overlap)), "spliced")
        done = counts.filter("n_tokens is not null")
        result = done if result is None else result.unionByName(done)
        failed = counts.filter("n_tokens is null").select("text_key")
        if failed.isEmpty():
            return result
        waiting = texts.join(failed, "text_key", "left_semi")
        chunk = 2 * chunk
        overlap = min(4 * overlap, chunk // 2)


ship(__name__)
