"""Byte-pair encoding by speculation: greedy longest matches, checked pair by pair.

A text is cut before single spaces, where byte-level pre-tokenisation always cuts, and every different
piece of a batch is encoded once:

1. *Speculate*: one pass of an automaton over all new words proposes the longest tokens from the left.
2. *Verify*: a proposal is the encoding exactly if every two neighbours would be left apart by the
   merges. All neighbours of all words are tested together: numpy takes the merges of both tokens
   back, latest first, and looks for an earlier merge across the border.
3. *Repair*: only words with a failing pair go through the merges in their order.

Null texts count as empty and give no ids. Repeated rows stay. Memory per task is the vocabulary, a
batch of 4 MB of text (or one longer text) and a cache of bounded size. No row is moved. Empty tables give empty
results. Other columns may have any names; those of added columns give way.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import re

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from public_tokenizers import PATTERN
from pyspark.sql import DataFrame
from pyspark.sql.types import ArrayType, IntegerType, LongType, StringType, StructField
from tokenizers import pre_tokenizers

from sluicegate.llm.common import annotate, once, ship

# Encoded pieces that a worker remembers; beyond it starts again.
CACHED_PIECES = 200_000
# Longer words are merged one by one, with a heap.
SHORT_WORD = 64
NEVER = np.int64(1) << 40
SEPARATOR = "\u0100"
# The split that byte-level pre-tokenisation of this kind defines.
WORD = regex.compile(PATTERN)
# Below it the classes of characters are the same in every version of Unicode that a library may have.
STABLE = "\u0250"
# A space with white space before and after it doesn't always start a word.
UNCLEAR_SPACE = re.compile(r"\s (?:\s|\Z)")
CLEAR_SPACE = re.compile(r"(?<=\S) (?=\S)")


def pieces(text: str) -> list[str]:
    """Cut a text where pre-tokenisation cuts whatever stands around: before a clear single space."""
    if UNCLEAR_SPACE.search(text):
        parts = CLEAR_SPACE.split(text)
    else:
        parts = text.split(" ")
    cut = [" " + part for part in parts]
    cut[0] = parts[0]
    return cut


class ByteBpe:
    """Encoder and decoder of a byte-level BPE file of the tokenizers library."""

    def __init__(self, content: str):
        spec = json.loads(content)
        model, splitter = spec["model"], spec["pre_tokenizer"] or {}
        extra = ("unk_token", "dropout", "continuing_subword_prefix", "end_of_word_suffix", "ignore_merges")
        if (
            model["type"] != "BPE"
            or spec["normalizer"]
            or splitter.get("type") != "ByteLevel"
            or splitter["add_prefix_space"]
            or not splitter["use_regex"]
            or any(model.get(name) for name in extra)
            or any(t["lstrip"] or t["rstrip"] or t["single_word"] for t in spec["added_tokens"])
        ):
            raise ValueError("only byte-level BPE without normaliser, prefixes and suffixes is supported")
        self.splitter = pre_tokenizers.ByteLevel(add_prefix_space=False)
        self.vocabulary = model["vocab"]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        longest_first = sorted(self.special, key=len, reverse=True)
        self.find_special = re.compile("(" + ("|".join(map(re.escape, longest_first)) or "(?!)") + ")")
        self._load_merges(model["merges"])
        self._load_bytes()
        self.automaton = ahocorasick.Automaton()
        for token in np.flatnonzero(self.usable):
            self.automaton.add_word(self.text_of[token], int(token))
        self.automaton.make_automaton()
        self.words: dict[str, bytes] = {}
        self.cache: dict[str, bytes] = {}
        self.counts = {"words": 0, "repaired": 0}

    def _load_merges(self, merges: list) -> None:
        size = max(max(self.vocabulary.values()), max(self.special.values(), default=0)) + 1
        self.left, self.right = np.arange(size), np.arange(size)
        self.rank = np.full(size, -1, dtype=np.int64)
        self.pair_rank: dict[tuple[int, int], tuple[int, int]] = {}
        keys, ranks = [], []
        self.ordered = True
        for rank, merge in enumerate(merges):
            first, second = merge.split(" ") if isinstance(merge, str) else merge
            a, b, made = self.vocabulary[first], self.vocabulary[second], self.vocabulary[first + second]
            # The check needs tokens that are made in one way, after their parts.
            self.ordered &= self.rank[made] == -1 and self.rank[a] < rank and self.rank[b] < rank
            self.left[made], self.right[made], self.rank[made] = a, b, rank
            self.pair_rank[a, b] = (rank, made)
            keys.append(a * size + b)
            ranks.append(rank)
        order = np.argsort(keys)
        self.size = size
        self.made_by_rank = np.array([self.pair_rank[key // size, key % size][1] for key in keys])
        self.pair_keys = np.asarray(keys, dtype=np.int64)[order]
        self.pair_ranks = np.asarray(ranks, dtype=np.int64)[order]
        self.usable = np.zeros(size, dtype=bool)
        self.usable[list(self.vocabulary.values())] = True
        merged = np.flatnonzero(self.rank >= 0)
        # A token that the merges of its own text would not give must never be proposed.
        whole = self.apart(self.left[merged], self.right[merged], self.rank[merged])
        for token, good in sorted(zip(merged, whole), key=lambda pair: self.rank[pair[0]]):
            self.usable[token] = good and self.usable[self.left[token]] and self.usable[self.right[token]]

    def _load_bytes(self) -> None:
        # The printable stand-ins of the 256 bytes, as byte-level vocabularies define them.
        plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
        stand_in = {b: chr(b) for b in plain}
        for number, b in enumerate(b for b in range(256) if b not in stand_in):
            stand_in[b] = chr(256 + number)
        # In here a byte is the character of its number; nothing else can be a separator.
        self.byte_of = {ord(char): chr(b) for b, char in stand_in.items()}
        self.text_of = [""] * self.size
        raw = [b""] * self.size
        for text, token in self.vocabulary.items():
            self.text_of[token] = text.translate(self.byte_of)
            raw[token] = self.text_of[token].encode("latin-1")
        for text, token in self.special.items():
            raw[token] = text.encode()
        self.id_of_byte = np.array([self.vocabulary[stand_in[b]] for b in range(256)], dtype=np.int64)
        self.text_size = np.array([len(x) for x in self.text_of], dtype=np.int64)
        self.raw = np.frombuffer(b"".join(raw), dtype=np.uint8)
        self.raw_size = np.array([len(x) for x in raw], dtype=np.int64)
        self.raw_start = np.cumsum(self.raw_size) - self.raw_size

    def merges_at(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The rank of the merge of each pair, NEVER if there is none."""
        keys = a * self.size + b
        place = np.minimum(np.searchsorted(self.pair_keys, keys), len(self.pair_keys) - 1)
        return np.where(self.pair_keys[place] == keys, self.pair_ranks[place], NEVER)

    def apart(self, a: np.ndarray, b: np.ndarray, until: np.ndarray | None = None) -> np.ndarray:
        """Whether the merges, up to rank ``until``, leave each two neighbours apart.

        Merges act in rank order, leftmost first. Taking back the latest merge on either side gives the
        tokens that stood at the border before it; a merge of these two that comes first would have
        joined them.
        """
        result = np.ones(len(a), dtype=bool)
        row = np.arange(len(a))
        before = np.full(len(a), NEVER) if until is None else until.copy()
        a, b = a.copy(), b.copy()
        while len(row):
            joined = self.merges_at(a, b) < before
            result[row[joined]] = False
            made_a, made_b = self.rank[a], self.rank[b]
            going = ~joined & (np.maximum(made_a, made_b) >= 0)
            undo_a = made_a > made_b  # of two equal merges the left one came first
            before = np.where(undo_a, made_a, made_b + 1)[going]
            row, a, b = (
                row[going],
                np.where(undo_a, self.right[a], a)[going],
                np.where(undo_a, b, self.left[b])[going],
            )
        return result

    def propose(self, words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Greedy longest tokens of words: ids, each word's end in them, and whether they cover it."""
        ids, ends = [], []
        for end, token in self.automaton.iter_long(SEPARATOR.join(words)):
            ids.append(token)
            ends.append(end)
        ids, ends = np.array(ids, dtype=np.int64), np.array(ends, dtype=np.int64)
        size = np.array([len(word) for word in words], dtype=np.int64)
        last = np.cumsum(size + 1) - 2  # place of each word's last character
        upto = np.searchsorted(ends, last, side="right")
        covered = np.add.reduceat(
            np.append(self.text_size[ids], 0), np.minimum(np.append(0, upto[:-1]), len(ids))
        )
        covered[np.diff(np.append(0, upto)) == 0] = 0
        return ids, upto, covered == size

    def merge_exactly(self, word: str) -> list[int]:
        """The merges one by one, lowest rank and leftmost first, in O(n log n)."""
        ids = self.id_of_byte[np.frombuffer(word.encode("latin-1"), dtype=np.uint8)].tolist()
        after = [*range(1, len(ids)), -1]
        before = [-1, *range(len(ids) - 1)]
        heap = []

        def offer(place: int) -> None:
            if place >= 0 and after[place] >= 0:
                found = self.pair_rank.get((ids[place], ids[after[place]]))
                if found:
                    heapq.heappush(heap, (found[0], place, ids[place], ids[after[place]], found[1]))

        for place in range(len(ids) - 1):
            offer(place)
        while heap:
            _, place, a, b, made = heapq.heappop(heap)
            other = after[place]
            if ids[place] != a or other < 0 or ids[other] != b:
                continue  # one of the two has been merged meanwhile
            ids[place], ids[other] = made, -1
            after[place] = after[other]
            if after[place] >= 0:
                before[after[place]] = place
            offer(before[place])
            offer(place)
        return [token for token in ids if token >= 0]

    def merge_together(self, words: list[str]) -> list[bytes]:
        """The merges of many short words at once, one merge per word and round."""
        size = np.array([len(word) for word in words], dtype=np.int64)
        ids = self.id_of_byte[np.frombuffer("".join(words).encode("latin-1"), dtype=np.uint8)]
        word = np.repeat(np.arange(len(words)), size)
        out_ids, out_word = [], []
        while len(ids):
            ranks = np.full(len(ids), NEVER)
            ranks[:-1] = np.where(word[:-1] == word[1:], self.merges_at(ids[:-1], ids[1:]), NEVER)
            start = np.flatnonzero(np.append(True, word[1:] != word[:-1]))
            length = np.diff(np.append(start, len(ids)))
            least = np.repeat(np.minimum.reduceat(ranks, start), length)
            done = least == NEVER
            out_ids.append(ids[done])
            out_word.append(word[done])
            at = np.flatnonzero((ranks == least) & ~done)
            if not len(at):
                break
            at = at[np.append(True, word[at[1:]] != word[at[:-1]])]  # the leftmost of a word's equals
            ids[at] = self.made_by_rank[ranks[at]]
            left = ~done
            left[at + 1] = False
            ids, word = ids[left], word[left]
        ids, word = np.concatenate(out_ids), np.concatenate(out_word)
        data = ids[np.argsort(word, kind="stable")].astype("<u4").tobytes()
        ends = 4 * np.cumsum(np.bincount(word, minlength=len(words)))
        return [data[a:b] for a, b in zip([0, *ends[:-1].tolist()], ends.tolist())]

    def encode_words(self, words: list[str]) -> None:
        """Add the ids of new words to the cache."""
        ids, upto, whole = self.propose(words)
        if self.ordered:
            start = np.append(0, upto[:-1])
            inside = np.ones(len(ids), dtype=bool)
            inside[upto[upto > 0] - 1] = False  # a word's last token has no neighbour in it
            place = np.flatnonzero(inside)
            good = np.ones(len(ids) + 1, dtype=bool)
            good[place] = self.apart(ids[place], ids[place + 1]) if len(place) else True
            whole &= np.logical_and.reduceat(good, start)
        else:
            whole[:] = False
        data = ids.astype("<u4").tobytes()
        failing, at = [], 0
        for word, end, right in zip(words, upto.tolist(), whole.tolist()):
            if right:
                self.words[word] = data[4 * at : 4 * end]
            elif len(word) > SHORT_WORD:
                self.words[word] = np.array(self.merge_exactly(word), dtype="<u4").tobytes()
            else:
                failing.append(word)
            at = end
        if failing:
            self.words.update(zip(failing, self.merge_together(failing)))
        self.counts["words"] += len(words)
        self.counts["repaired"] += len(words) - int(whole.sum())

    def split(self, piece: str) -> list[str | bytes]:
        """Words of a piece, a character per byte; special tokens as their id's bytes."""
        if piece.isascii() or max(piece) < STABLE:
            if not self.find_special.search(piece):
                words = WORD.findall(piece)
                return words if piece.isascii() else [word.encode().decode("latin-1") for word in words]
        out: list[str | bytes] = []
        for number, part in enumerate(self.find_special.split(piece)):
            if number % 2:
                out.append(self.special[part].to_bytes(4, "little"))
            elif part:
                split = self.splitter.pre_tokenize_str(part)
                out.extend(word.translate(self.byte_of) for word, _ in split)
        return out

    def learn(self, new: set[str]) -> None:
        cut = {piece: self.split(piece) for piece in new}
        words = {word for parts in cut.values() for word in parts if isinstance(word, str)}
        words -= self.words.keys()
        if words:
            self.encode_words(list(words))
        known = self.words
        for piece, parts in cut.items():
            self.cache[piece] = b"".join(
                [part if isinstance(part, bytes) else known[part] for part in parts]
            )
        if len(self.words) > CACHED_PIECES:
            self.words = {}

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """Ids of each text as little-endian unsigned 32-bit integers."""
        cut = [pieces(text or "") for text in texts]
        if len(self.cache) > CACHED_PIECES:
            self.cache = {}
        new = {piece for parts in cut for piece in parts} - self.cache.keys()
        if new:
            self.learn(new)
        known = self.cache.__getitem__
        return [b"".join(map(known, parts)) for parts in cut]

    def decode(self, data: bytes) -> str:
        """The text of ids, special tokens included; bytes that are no UTF-8 become U+FFFD."""
        ids = np.frombuffer(data, dtype="<u4").astype(np.int64)
        ids = ids[ids < self.size]  # ids that no token has give nothing
        size = self.raw_size[ids]
        first = np.repeat(self.raw_start[ids] - (np.cumsum(size) - size), size)
        return self.raw[first + np.arange(len(first))].tobytes().decode("utf-8", "replace")


def load(docs: DataFrame, path: str):
    """A function that gives the encoder in a worker. The file, of fixed size, is read here once."""
    with open(path, encoding="utf-8") as file:
        content = file.read()
    shared = docs.sparkSession.sparkContext.broadcast(content)
    digest = hashlib.sha256(content.encode()).hexdigest()
    return lambda: once(("byte_bpe", digest), lambda: ByteBpe(shared.value))


def encode_column(
    docs: DataFrame, path: str, text: str = "text", ids: str = "ids", keep: list[str] | None = None
) -> DataFrame:
    """The token ids of a text column, as ``array<int>``; a null text has no ids (an empty array)."""
    encoder = load(docs, path)

    def start():
        bpe = encoder()

        def work(texts):
            encoded = bpe.encode(texts)
            flat = np.frombuffer(b"".join(encoded), dtype="<i4")
            ends = np.cumsum([0] + [len(x) // 4 for x in encoded], dtype=np.int32)
            return [pa.ListArray.from_arrays(pa.array(ends), pa.array(flat))]

        return work

    return annotate(docs, [StructField(ids, ArrayType(IntegerType()), True)], start, text, keep)


def decode_column(
    docs: DataFrame, path: str, ids: str = "ids", text: str = "text", keep: list[str] | None = None
) -> DataFrame:
    """The text of a column of token ids; null ids, and ids that no token has, give nothing."""
    encoder = load(docs, path)
    names = [c for c in (docs.columns if keep is None else keep) if c.lower() not in (ids.lower(), text.lower())]

    def run(batches):
        for batch in batches:
            bpe = encoder()
            made = [
                bpe.decode(np.array([i for i in row or () if i is not None and i >= 0], dtype="<u4").tobytes())
                for row in batch.column(len(names)).to_pylist()
            ]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[: len(names)], pa.array(made, pa.string())], names=[*names, text]
            )

    columns = [f"`{c}`" for c in names]
    schema = ", ".join([f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in names] + [f"`{text}` string"])
    return docs.select(*columns, f"`{ids}`").mapInArrow(run, schema)


def round_trip(docs: DataFrame, path: str, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """Encode and decode a text column: n_tokens, ids_sha256 and decoded_sha256 after ``keep``.

    The digests are of the ids' bytes and of the decoded text; neither ids nor texts leave the task.
    """
    encoder = load(docs, path)

    def start():
        bpe = encoder()

        def work(texts):
            encoded = bpe.encode(texts)
            return [
                pa.array([len(x) // 4 for x in encoded], pa.int64()),
                pa.array([hashlib.sha256(x).hexdigest() for x in encoded], pa.string()),
                pa.array([hashlib.sha256(bpe.decode(x).encode()).hexdigest() for x in encoded], pa.string()),
            ]

        return work

    fields = [
        StructField("n_tokens", LongType()),
        StructField("ids_sha256", StringType()),
        StructField("decoded_sha256", StringType()),
    ]
    return annotate(docs, fields, start, text, keep)


ship(__name__)
