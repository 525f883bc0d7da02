"""Alignment of the tokens of two tokenizers: byte-level BPE (A) and sentencepiece with byte fallback (B).

Both tokenizers get the text with one space before it: A as it stands, B adds the space itself. The bytes of a
token of A are its byte-level characters decoded; those of a token of B are its piece in UTF-8 with U+2581 as a
space, or the byte that ``<0xHH>`` names.

*Coarse cuts* are what the libraries report: the character offsets of A's tokens and the spans of B's pieces (the
``proto`` result, which replaces the immutable proto in the installed sentencepiece). *Refinement*: a token that
ends inside a character, or a byte-fallback piece with an empty span, has no true end there; where a span
doesn't fit the token's decoded bytes, its end follows from these. Places where tokens of both end cut the tokens
into *groups*; two tokens are *linked* if their bytes overlap. A text is aligned only if the joined bytes of both
sides are those of the space and the text; else, and for null and empty texts, it has no tokens.

Both tokenizers cut before a single space that has no white space around it: A always does, and B because none of
its pieces has a space after another character (checked when the model is loaded; without that, texts are
aligned whole). So a text is aligned segment by segment, and a worker aligns each different segment once.

*Counts*: the links of the whole corpus are counted per pair of ids; tasks add up the pairs of their rows before
anything moves. The counts go back to the rows by
broadcast, at most ``PAIRS_PER_PASS`` pairs at a time; more pairs take more passes, all exact, because the sums
of a row are sums over its pairs.

Repeated rows stay and count each. Very long texts are rows like others: memory per task is the two vocabularies,
half a MB of texts (or one longer text), a cache of bounded size, and the pairs of one pass. Empty tables give empty
results. Other columns may have any names; those of added columns give way.
"""

from __future__ import annotations

import hashlib
import json
import re
from itertools import chain

import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, LongType, StringType, StructField
from tokenizers import Tokenizer

from sluicegate.llm.common import annotate, once, sheltered, ship
from sluicegate.session import stored

CACHED_SEGMENTS = 300_000
# Bytes of text at a time; what the tokens of a text take is several times that.
BATCH_BYTES = 1 << 19
# Characters that are encoded at a time, as far as segments allow.
CHUNK = 20_000
PAIRS_PER_PASS = 4_000_000
# Links that are looked up at a time.
LINKS_AT_A_TIME = 1 << 18
CLEAR_SPACE = re.compile(r"(?<=\S) (?=\S)")
SPACE = "▁"


def bytes_of_a(spec: dict) -> tuple[list[bytes], int]:
    """The bytes of each token of a byte-level vocabulary, and one more than its largest id."""
    # The stand-ins of the 256 bytes: printable ones stand for themselves, the others follow 255 in order.
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    byte_of = {chr(b): b for b in plain}
    byte_of.update({chr(256 + n): b for n, b in enumerate(b for b in range(256) if chr(b) not in byte_of)})
    size = 1 + max([*spec["model"]["vocab"].values(), *[t["id"] for t in spec["added_tokens"]]])
    raw = [b""] * size
    for token, number in spec["model"]["vocab"].items():
        if all(char in byte_of for char in token):
            raw[number] = bytes(byte_of[char] for char in token)
    return raw, size


def bytes_of_b(model: sentencepiece.SentencePieceProcessor) -> list[bytes]:
    """The bytes of each piece."""
    return [
        bytes([int(model.id_to_piece(i)[3:5], 16)])
        if model.is_byte(i)
        else model.id_to_piece(i).replace(SPACE, " ").encode()
        for i in range(model.get_piece_size())
    ]


def byte_ends(spans: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Where tokens end, in bytes: a reported span counts if it has as many bytes as the token.

    That makes its end a coarse cut. Tokens from there to the next one, inside a character or with an empty span,
    end where their own bytes do.
    """
    fits = spans[:, 1] - spans[:, 0] == sizes
    last = np.maximum.accumulate(np.where(fits, np.arange(len(sizes)), -1))
    so_far = np.cumsum(sizes)
    cut, before = np.where(last >= 0, spans[last, 1], 0), np.where(last >= 0, so_far[last], 0)
    return cut + so_far - before


class Vocabulary:
    """The bytes of all tokens in one array."""

    def __init__(self, raw: list[bytes]):
        self.data = np.frombuffer(b"".join(raw), dtype=np.uint8)
        self.size = np.array([len(x) for x in raw], dtype=np.int64)
        self.start = np.cumsum(self.size) - self.size

    def joined(self, ids: np.ndarray) -> np.ndarray:
        size = self.size[ids]
        shift = np.repeat(self.start[ids] - (np.cumsum(size) - size), size)
        return self.data[shift + np.arange(len(shift))]


class Aligner:
    """Both tokenizers, and the alignments of the segments they have seen."""

    def __init__(self, content: str, model: bytes):
        spec = json.loads(content)
        splitter = spec["pre_tokenizer"] or {}
        if splitter.get("type") != "ByteLevel" or splitter["add_prefix_space"] or spec["normalizer"]:
            raise ValueError("only byte-level tokenizers without prefixes and normalisers are supported")
        self.a = Tokenizer.from_str(content)
        self.a.no_truncation()
        self.a.no_padding()
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_proto=model)
        raw_a, self.size_a = bytes_of_a(spec)
        raw_b = bytes_of_b(self.b)
        self.bytes_a, self.bytes_b = Vocabulary(raw_a), Vocabulary(raw_b)
        self.number = np.int32 if fits_int(self.size_a * len(raw_b)) else np.int64
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        self.cuts = not any(SPACE in piece.lstrip(SPACE) for piece in pieces)
        # What a token adds to the text of groups: more of its side follow, or none.
        self.shown = [f"{i}{end}" for i in range(len(raw_a)) for end in ",|"]
        self.first_b = len(self.shown)
        self.shown += [f"{i}{end}" for i in range(len(raw_b)) for end in ",;"]
        self.shown_size = np.array([len(x) for x in self.shown], dtype=np.int64)
        self.forget()

    def forget(self) -> None:
        self.place: dict[str, int] = {}
        self.groups: list[str] = []
        # n_a (-1 if the bytes differ), n_b, n_groups, n_links of the segments, and their links one after the other.
        self.numbers = np.zeros((0, 4), dtype=np.int32)
        self.links = np.zeros(0, dtype=self.number)
        self.hits = np.zeros(0, dtype=np.int32)

    def forget_rare(self) -> None:
        """Keep the segments that were seen again since the last time, at most half of those that fit."""
        order = np.argsort(-self.hits, kind="stable")[: CACHED_SEGMENTS // 2]
        kept = np.sort(order[self.hits[order] > 1])
        new = np.full(len(self.hits), -1)
        new[kept] = np.arange(len(kept))
        places = new.tolist()
        self.place = {segment: places[place] for segment, place in self.place.items() if places[place] >= 0}
        self.groups = [self.groups[place] for place in kept.tolist()]
        number = self.numbers[:, 3].astype(np.int64)
        first = np.cumsum(number) - number
        number = number[kept]
        shift = np.repeat(first[kept] - (np.cumsum(number) - number), number)
        self.links = self.links[shift + np.arange(len(shift))]
        self.numbers = self.numbers[kept]
        self.hits = np.ones(len(kept), dtype=np.int32)

    def segments(self, text: str) -> list[str]:
        return CLEAR_SPACE.split(text) if self.cuts else [text]

    def tokens(self, segments: list[str]) -> tuple[bytes, np.ndarray, np.ndarray, np.ndarray, np.ndarray] | None:
        """Bytes of the segments, a space before each; ids and byte ends of A, then of B; None if the bytes differ."""
        text = " " + " ".join(segments)
        data = text.encode()
        one = self.a.encode(text, add_special_tokens=False)
        other = self.b.encode(text[1:], return_type="proto")
        ids_a = np.array(one.ids, dtype=np.int64)
        spans_a = np.fromiter(chain.from_iterable(one.offsets), np.int64, 2 * len(ids_a)).reshape(-1, 2)
        pieces = list(other.pieces)
        ids_b = np.array([piece.id for piece in pieces], dtype=np.int64)
        # Pieces begin where the one before ends. The space that B adds has no place in their spans.
        ends = np.array([piece.end for piece in pieces], dtype=np.int64) + 1
        spans_b = np.stack([np.append(0, ends[:-1]), ends], axis=1)
        whole = np.frombuffer(data, dtype=np.uint8)
        for ids, vocabulary in ((ids_a, self.bytes_a), (ids_b, self.bytes_b)):
            if vocabulary.size[ids].sum() != len(data) or not np.array_equal(vocabulary.joined(ids), whole):
                return None
        if len(data) != len(text):
            at = np.append(np.flatnonzero((whole & 0xC0) != 0x80), len(data))
            spans_a = at[spans_a]
        return (
            data,
            ids_a,
            byte_ends(spans_a, self.bytes_a.size[ids_a]),
            ids_b,
            byte_ends(spans_b, self.bytes_b.size[ids_b]),
        )

    def match(self, segments: list[str]) -> tuple[np.ndarray, np.ndarray, list[str]] | None:
        """Numbers, links (``b * size_a + a``) and groups of segments; None if one of them has other bytes."""
        found = self.tokens(segments)
        if found is None:
            return None
        data, ids_a, ends_a, ids_b, ends_b = found
        ends = np.cumsum([1 + (len(x) if x.isascii() else len(x.encode())) for x in segments])
        marks = np.zeros((4, len(data) + 1), dtype=np.int64)
        marks[0, ends_a] = marks[1, ends_b] = 1
        marks[2], marks[3] = marks[0] & marks[1], marks[0] | marks[1]
        if not marks[2, ends].all():
            return None
        before = np.cumsum(marks, axis=1)
        numbers = np.diff(before[:, ends], axis=1, prepend=0).T
        # Every end of either side ends a link: that of the two tokens before it.
        at = np.flatnonzero(marks[3]) - 1
        links = (ids_b[before[1, at]] * self.size_a + ids_a[before[0, at]]).astype(self.number)
        group_a, group_b = before[2, ends_a - 1], before[2, ends_b - 1]
        count = int(before[2, -1])
        older_b = np.append(0, np.cumsum(np.bincount(group_b, minlength=count)))
        older_a = np.append(0, np.cumsum(np.bincount(group_a, minlength=count)))
        shown = np.empty(len(ids_a) + len(ids_b), dtype=np.int64)
        shown[np.arange(len(ids_a)) + older_b[group_a]] = 2 * ids_a + marks[2, ends_a]
        shown[np.arange(len(ids_b)) + older_a[group_b + 1]] = self.first_b + 2 * ids_b + marks[2, ends_b]
        text = "".join(map(self.shown.__getitem__, shown.tolist()))
        until = np.cumsum(self.shown_size[shown])[np.cumsum(numbers[:, 0] + numbers[:, 1]) - 1].tolist()
        return numbers, links, [text[a:b] for a, b in zip([0, *until], until)]

    def learn(self, new: list[str]) -> None:
        chunks: list[list[str]] = [[]]
        alone, size = [], 0
        for segment in new:
            # Only between characters that are no white space does a space keep segments apart.
            if not self.cuts or segment != segment.strip() or SPACE in segment or not segment:
                alone.append([segment])
                continue
            chunks[-1].append(segment)
            size += len(segment) + 1
            if size > CHUNK:
                chunks.append([])
                size = 0
        numbers, links = [self.numbers], [self.links]
        waiting = [chunk for chunk in chunks if chunk] + alone
        while waiting:
            chunk = waiting.pop()
            found = self.match(chunk)
            if found is None and len(chunk) > 1:
                waiting += [chunk[: len(chunk) // 2], chunk[len(chunk) // 2 :]]
                continue
            found = found or (np.array([[-1, 0, 0, 0]]), self.links[:0], [""])
            for segment, groups in zip(chunk, found[2]):
                self.place[segment] = len(self.groups)
                self.groups.append(groups)
            numbers.append(found[0])
            links.append(found[1])
        self.numbers, self.links = np.concatenate(numbers).astype(np.int32), np.concatenate(links)
        self.hits = np.append(self.hits, np.zeros(len(self.numbers) - len(self.hits), dtype=np.int32))

    def align(self, texts: list[str | None]) -> list[pa.Array]:
        """n_a, n_b, n_groups, n_links, the groups as text, and the links of each text, in order."""
        if len(self.place) > CACHED_SEGMENTS:
            self.forget_rare()
        cut = [self.segments(text) if text else [] for text in texts]
        new = list(set(chain.from_iterable(cut)).difference(self.place))
        if new:
            self.learn(new)
        known = self.place.__getitem__
        places = [list(map(known, parts)) for parts in cut]
        sizes = np.array([len(parts) for parts in places], dtype=np.int64)
        row = np.repeat(np.arange(len(texts)), sizes)
        flat = np.fromiter(chain.from_iterable(places), dtype=np.int64, count=int(sizes.sum()))
        self.hits += np.bincount(flat, minlength=len(self.hits)).astype(np.int32)
        # A text with a segment that can't be aligned has no tokens.
        whole = np.ones(len(texts), dtype=bool)
        whole[row[self.numbers[flat, 0] < 0]] = False
        good = whole[row]
        row, flat = row[good], flat[good]
        sums = [np.bincount(row, column, len(texts)).astype(np.int64) for column in self.numbers[flat].T]
        each = self.numbers[flat, 3].astype(np.int64)
        first = np.cumsum(self.numbers[:, 3], dtype=np.int64) - self.numbers[:, 3]
        shift = np.repeat(first[flat] - (np.cumsum(each) - each), each)
        links = self.links[shift + np.arange(len(shift))]
        ends = np.append(0, np.cumsum(sums[3])).astype(np.int32)
        groups = self.groups.__getitem__
        shown = ["".join(map(groups, parts))[:-1] if fits else "" for parts, fits in zip(places, whole.tolist())]
        return [
            *[pa.array(column, pa.int64()) for column in sums],
            pa.array(shown, pa.string()),
            pa.ListArray.from_arrays(pa.array(ends), pa.array(links)),
        ]


def fits_int(pairs: int) -> bool:
    """Whether so many pairs have 32-bit numbers."""
    return pairs < 1 << 31


def _long(name: str) -> StructField:
    return StructField(name, LongType())


def align(
    docs: DataFrame, bytes_path: str, pieces_path: str, text: str = "text", keep: list[str] | None = None
) -> DataFrame:
    """Add the alignment of a text's tokens.

    n_a, n_b, n_groups, n_links; ``groups``, as ``a1,a2|b1;a3|b2,b3`` with the ids in order; ``links``, the ids of
    linked tokens in order, as ``b * size + a`` (see ``vocabulary_size``).
    """
    with open(bytes_path, encoding="utf-8") as file:
        content = file.read()
    with open(pieces_path, "rb") as file:
        model = file.read()
    shared = docs.sparkSession.sparkContext.broadcast((content, model))  # two files, of fixed size
    digest = hashlib.sha256(content.encode() + model).hexdigest()
    size_b = sentencepiece.SentencePieceProcessor(model_proto=model).get_piece_size()
    pair = IntegerType() if fits_int(vocabulary_size(bytes_path) * size_b) else LongType()

    def start():
        return once(("alignment", digest), lambda: Aligner(*shared.value)).align

    fields = [
        *map(_long, ("n_a", "n_b", "n_groups", "n_links")),
        StructField("groups", StringType()),
        StructField("links", ArrayType(pair, False)),
    ]

    def work(frame: DataFrame, names: dict[str, str]) -> DataFrame:
        kept = [names[c] for c in (docs.columns if keep is None else keep)]
        return annotate(frame, fields, start, names[text], kept, BATCH_BYTES)

    return sheltered(docs, work, keep, (text,))


def vocabulary_size(bytes_path: str) -> int:
    """What a pair of linked ids is divided by: the quotient is the id of B, the rest that of A."""
    with open(bytes_path, encoding="utf-8") as file:
        return bytes_of_a(json.load(file))[1]


def pair_counts(aligned: DataFrame, size: int) -> DataFrame:
    """pair, b, n: how many links of all rows hold a pair of ids."""
    counts = aligned.select(F.explode("links").alias("pair")).groupBy("pair").agg(F.count("*").alias("n"))
    return counts.select("pair", F.floor(F.col("pair") / F.lit(size)).cast("int").alias("b"), "n")


def passes(numbers: list[tuple[int, int]], most: int) -> list[tuple[int, int]]:
    """Ranges of ids of B, first and last, with at most ``most`` pairs each (an id with more stands alone)."""
    ranges: list[tuple[int, int]] = []
    total = 0
    for b, n in sorted(numbers):
        if not ranges or total + n > most:
            ranges.append((b, b))
            total = 0
        ranges[-1] = (ranges[-1][0], b)
        total += n
    return ranges


def _add_pass(frame: DataFrame, counts: DataFrame, size: int) -> DataFrame:
    """Add to n_best and count_sum what the pairs of one range of ids of B give."""
    table = counts.orderBy("pair").toArrow()
    pairs, n = table["pair"].to_numpy(), table["n"].to_numpy()
    shared = frame.sparkSession.sparkContext.broadcast((pairs, n, _best(pairs // size, n)))
    key = ("pair counts", int(pairs[0]), len(pairs))
    names = frame.columns
    links_at, best_at, sum_at = (names.index(c) for c in ("links", "n_best", "count_sum"))

    def run(batches):
        # Makes a worker drop the tokenizers that it has kept for the step before.
        known, counted, best = once(key, lambda: shared.value)
        for batch in batches:
            column = batch.column(links_at)
            ends = np.append(0, np.cumsum(np.diff(column.offsets.to_numpy())))
            links = column.flatten().to_numpy(zero_copy_only=False)
            sums = np.zeros((2, len(ends)), dtype=np.int64)  # up to the end of each row
            done = np.zeros(2, dtype=np.int64)
            row = 1
            for at in range(0, len(links), LINKS_AT_A_TIME):
                some = links[at : at + LINKS_AT_A_TIME]
                place = np.minimum(np.searchsorted(known, some), len(known) - 1)
                here = known[place] == some
                last = int(np.searchsorted(ends, at + len(some), side="right"))
                for which, values in enumerate((best, counted)):
                    so_far = np.append(0, np.cumsum(np.where(here, values[place], 0))) + done[which]
                    sums[which, row:last] = so_far[ends[row:last] - at]
                    done[which] = so_far[-1]
                row = last
            sums[:, row:] = done[:, None]
            columns = list(batch.columns)
            for number, total in ((best_at, sums[0]), (sum_at, sums[1])):
                columns[number] = pa.array(columns[number].to_numpy() + np.diff(total))
            yield pa.RecordBatch.from_arrays(columns, names=names)

    return frame.mapInArrow(run, frame.schema)


def _best(b: np.ndarray, n: np.ndarray) -> np.ndarray:
    """1 where a pair's count is the highest of its id of B, else 0; the ids are in order."""
    first = np.flatnonzero(np.append(True, b[1:] != b[:-1]))
    most = np.repeat(np.maximum.reduceat(n, first), np.diff(np.append(first, len(b))))
    return (n == most).astype(np.int64)


def add_counts(aligned: DataFrame, size: int, most: int = PAIRS_PER_PASS) -> DataFrame:
    """Add n_best and count_sum to stored alignments, instead of their ``links``.

    A pair's count is the number of links of all rows that hold it. count_sum is the sum over the links of a row,
    n_best the number of those whose count is the highest of their id of B.
    """
    counts = stored(pair_counts(aligned, size), "pair-counts")
    numbers = [tuple(row) for row in counts.groupBy("b").count().toArrow().to_pandas().itertuples(index=False)]
    frame = aligned.withColumns({"n_best": F.lit(0).cast("long"), "count_sum": F.lit(0).cast("long")})
    for first, last in passes(numbers, most):
        frame = _add_pass(frame, counts.filter(F.col("b").between(first, last)), size)
    return frame.drop("links")


ship(__name__)
