"""Languages of mixed text: script ranges, per-word scores, and Viterbi with a price for switching.

*Learning* counts hashed letter n-grams and scripts per language over a bounded sample: about
``rows_per_language`` rows of each language, drawn by a hash of their keys, with whole texts. Tasks count, and
at most ``buckets`` numbers per language go to the driver and out again.

*Labelling*: the script of a word leaves the languages that were seen in it; these get the log-probability of
the word's n-grams. Viterbi then labels the words of a text with the languages that have the highest sum, less
``penalty`` for every switch. All texts of a batch take their steps together. The language of a text is the one
with most letters, its score the share of letters so labelled.

Null texts and texts without a letter are ``und`` with score 0. Words in a script that no language was seen in
take the language around them but count for none; a text of only such words gets the most frequent
language with score 0. Without any row to
learn from every text is ``und``. Rows with a null language aren't learned from. Repeated rows stay; empty tables give empty results. Other columns may
have any names; those of added columns give way. Memory per
task is the model, 4 MB of texts (or one longer text) and a bounded cache. No row is moved.
"""

from __future__ import annotations

import re
import zlib
from bisect import bisect_right
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import (
    ArrayType,
    DoubleType,
    IntegerType,
    LongType,
    StringType,
    StructField,
    StructType,
)

from sluicegate.llm.common import annotate, forget, once, ship

BUCKETS = 1 << 15
ROWS_PER_LANGUAGE = 400
PENALTY = 10.0
SMOOTHING = 0.2
# A language is a candidate in a script that has this share of its letters.
SCRIPT_SHARE = 0.01
CACHED_PIECES = 400_000
EXCLUDED = -1e4
UNKNOWN = "und"
# First code points of blocks, and their script.
SCRIPT_BLOCKS = (
    (0x0000, "latin"), (0x0370, "greek"), (0x0400, "cyrillic"), (0x0530, "armenian"), (0x0590, "hebrew"),
    (0x0600, "arabic"), (0x0700, "other"), (0x0750, "arabic"), (0x0780, "other"), (0x08A0, "arabic"),
    (0x0900, "devanagari"), (0x0980, "bengali"), (0x0A00, "gurmukhi"), (0x0A80, "gujarati"),
    (0x0B00, "odia"), (0x0B80, "tamil"), (0x0C00, "telugu"), (0x0C80, "kannada"), (0x0D00, "malayalam"),
    (0x0D80, "sinhala"), (0x0E00, "thai"), (0x0E80, "lao"), (0x0F00, "tibetan"), (0x1000, "myanmar"),
    (0x10A0, "georgian"), (0x1100, "hangul"), (0x1200, "ethiopic"), (0x13A0, "other"), (0x1780, "khmer"),
    (0x1800, "mongolian"), (0x18B0, "other"), (0x1C80, "cyrillic"), (0x1C90, "georgian"), (0x1CC0, "other"),
    (0x1D00, "latin"), (0x1F00, "greek"), (0x2000, "other"), (0x2C60, "latin"), (0x2C80, "other"),
    (0x2DE0, "cyrillic"), (0x2E00, "other"), (0x3040, "kana"), (0x3100, "other"), (0x3130, "hangul"),
    (0x3190, "other"), (0x31F0, "kana"), (0x3200, "other"), (0x3400, "han"), (0xA000, "other"),
    (0xA640, "cyrillic"), (0xA6A0, "other"), (0xA720, "latin"), (0xA800, "other"), (0xAC00, "hangul"),
    (0xD7FC, "other"), (0xF900, "han"), (0xFB00, "latin"), (0xFB13, "armenian"), (0xFB1D, "hebrew"),
    (0xFB50, "arabic"), (0xFE00, "other"), (0xFE70, "arabic"), (0xFF00, "latin"), (0xFF66, "kana"),
    (0xFFA0, "hangul"), (0xFFE0, "other"), (0x20000, "han"), (0x32000, "other"),
)
SCRIPTS = sorted({script for _, script in SCRIPT_BLOCKS})
_STARTS = [start for start, _ in SCRIPT_BLOCKS]
_NUMBERS = [SCRIPTS.index(script) for _, script in SCRIPT_BLOCKS]
# Letters and the numerals that aren't digits, such as those of fractions and Roman numbers.
LETTERS = re.compile(r"[^\W\d_]+")


def letter_runs(text: str) -> list[str]:
    """Runs of letters (general category L) of a text."""
    found = LETTERS.findall(text)
    if text.isascii() or all(map(str.isalpha, found)):
        return found
    return "".join(char if char.isalpha() else " " for char in text).split()


def script_of(word: str) -> int:
    """Number of the script that most letters of a word belong to; the first one of equals."""
    if word.isascii():
        return _NUMBERS[0]
    numbers = [_NUMBERS[bisect_right(_STARTS, ord(char)) - 1] for char in word]
    return max(sorted(set(numbers)), key=numbers.count)


def grams(word: str, buckets: int) -> list[int]:
    """Buckets of the letter triples of a word with borders, and of the word itself."""
    marked = f"<{word}>"
    found = [zlib.crc32(marked[i : i + 3].encode()) % buckets for i in range(len(marked) - 2)]
    found.append(zlib.crc32(f"={word}".encode()) % buckets)
    return found


@dataclass
class Model:
    """Languages, the most frequent first; log-probabilities per bucket; scripts in which they occur."""

    languages: list[str]
    scores: np.ndarray  # buckets x languages
    allowed: np.ndarray  # scripts x languages


def fit(
    docs: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    lang: str = "lang",
    rows_per_language: int = ROWS_PER_LANGUAGE,
    buckets: int = BUCKETS,
) -> Model:
    """Count n-grams and scripts of a sample; see above."""
    known = docs.filter(F.col(lang).isNotNull()).select(
        F.col(key).cast("string").alias("sampled key"), F.col(lang).alias("language"), F.col(text).alias("words")
    )
    rows = {row[0]: row[1] for row in known.groupBy("language").count().collect()}
    languages = sorted(rows, key=lambda name: (-rows[name], name))
    if not languages:
        return Model([], np.zeros((buckets, 0)), np.zeros((len(SCRIPTS), 0), dtype=bool))
    # A row per language, as the model has them, too.
    share = F.create_map(
        *[F.lit(x) for name in languages for x in (name, min(1.0, rows_per_language / rows[name]))]
    )
    draw = F.pmod(F.xxhash64(F.lit("language sample"), "sampled key"), F.lit(1 << 20)) / (1 << 20)
    sample = known.filter(draw < F.element_at(share, F.col("language"))).select("language", "words")

    def run(batches):
        forget()
        for batch in batches:
            counts: dict[tuple[str, int], int] = {}
            for name, value in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                for word in letter_runs((value or "").lower()):
                    for place in (*grams(word, buckets), buckets + script_of(word)):
                        counts[name, place] = counts.get((name, place), 0) + 1
            if counts:
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([name for name, _ in counts], pa.string()),
                        pa.array([place for _, place in counts], pa.int32()),
                        pa.array(list(counts.values()), pa.int64()),
                    ],
                    names=["language", "place", "n"],
                )

    counted = sample.mapInArrow(run, "language string, place int, n long").groupBy("language", "place")
    table = counted.agg(F.sum("n").alias("n")).toArrow()
    numbers = np.zeros((buckets + len(SCRIPTS), len(languages)))
    column = {name: i for i, name in enumerate(languages)}
    numbers[table["place"].to_numpy(), [column[x] for x in table["language"].to_pylist()]] = table["n"].to_numpy()
    total = numbers[:buckets].sum(axis=0)
    scores = np.log((numbers[:buckets] + SMOOTHING) / (total + SMOOTHING * buckets))
    letters = numbers[buckets:]
    allowed = letters > SCRIPT_SHARE * np.maximum(letters.sum(axis=0), 1)
    return Model(languages, scores, allowed)


class Labeller:
    """Word scores of a model, remembered, and paths through texts."""

    def __init__(self, model: Model, penalty: float):
        self.model, self.penalty = model, penalty
        self.forget()

    def forget(self) -> None:
        self.place: dict[str, int] = {}
        self.scores = np.zeros((1024, len(self.model.languages)))
        self.letters = np.zeros(1024, dtype=np.int64)
        self.known = np.zeros(1024, dtype=np.int64)

    def learn(self, new: set[str]) -> None:
        need = len(self.place) + len(new)
        if need > len(self.letters):
            more = max(need, 2 * len(self.letters)) - len(self.letters)
            self.scores = np.vstack([self.scores, np.zeros((more, self.scores.shape[1]))])
            self.letters = np.append(self.letters, np.zeros(more, dtype=np.int64))
            self.known = np.append(self.known, np.zeros(more, dtype=np.int64))
        table, allowed = self.model.scores, self.model.allowed
        for piece in new:
            row = len(self.place)
            self.place[piece] = row
            self.scores[row] = 0
            self.letters[row] = self.known[row] = 0
            for word in letter_runs(piece):
                self.letters[row] += len(word)
                able = allowed[script_of(word)]
                if able.any():
                    self.known[row] += len(word)
                    sums = table[grams(word, len(table))].sum(axis=0)
                    self.scores[row] += np.where(able, sums, EXCLUDED)

    def paths(self, texts: list[str | None]) -> tuple[list, list, list, list]:
        """Pieces of each text, the language number of each piece, its letters and those of known scripts."""
        if len(self.place) > CACHED_PIECES:
            self.forget()
        cut = [(text or "").lower().split() for text in texts]
        new = {piece for parts in cut for piece in parts} - self.place.keys()
        self.learn(new)
        place = self.place.__getitem__
        rows = [np.fromiter(map(place, parts), dtype=np.int64, count=len(parts)) for parts in cut]
        order = sorted(range(len(rows)), key=lambda i: -len(rows[i]))
        size = np.array([len(rows[i]) for i in order], dtype=np.int64)
        flat = np.concatenate([rows[i] for i in order]) if rows else np.zeros(0, dtype=np.int64)
        start = np.cumsum(size) - size
        step = np.arange(len(flat)) - np.repeat(start, size)
        by_step = np.argsort(step, kind="stable")  # of each step, the longer texts first
        going = np.bincount(step, minlength=1)
        ends = np.cumsum(going)
        number = len(self.model.languages)
        best = np.zeros((len(rows), number))
        stays = np.empty((len(flat), number), dtype=bool)
        comes = np.empty(len(flat), dtype=np.int64)
        for t, end in enumerate(ends.tolist() if len(flat) else []):
            n = int(going[t])
            now = best[:n]
            comes[end - n : end] = now.argmax(axis=1)
            jump = now.max(axis=1, keepdims=True) - (self.penalty if t else 0.0)
            stays[end - n : end] = now >= jump
            best[:n] = np.maximum(now, jump) + self.scores[flat[by_step[end - n : end]]]
        state = best.argmax(axis=1) if number and len(rows) else np.zeros(len(rows), dtype=np.int64)
        path = np.empty(len(flat), dtype=np.int64)
        for t in range(len(going) - 1 if len(flat) else -1, -1, -1):
            end, n = int(ends[t]), int(going[t])
            path[end - n : end] = state[:n]
            keep = stays[end - n : end][np.arange(n), state[:n]]
            state[:n] = np.where(keep, state[:n], comes[end - n : end])
        labels = np.empty(len(flat), dtype=np.int64)
        labels[by_step] = path
        found: list[np.ndarray] = [labels[:0]] * len(rows)
        for i, at, n in zip(order, start.tolist(), size.tolist()):
            found[i] = labels[at : at + n]
        return cut, found, [self.letters[r] for r in rows], [self.known[r] for r in rows]

    def label(self, texts: list[str | None], with_spans: bool) -> tuple[list, list, list, list]:
        languages = self.model.languages
        names, shares, runs, spans = [], [], [], []
        if not languages:
            return [UNKNOWN] * len(texts), [0.0] * len(texts), [0] * len(texts), [[] for _ in texts]
        for text, path, letters, known in zip(texts, *self.paths(texts)[1:]):
            path_of_words = path[letters > 0]
            total = int(letters.sum())
            if not total:
                names.append(UNKNOWN)
                shares.append(0.0)
                runs.append(0)
                spans.append([])
                continue
            by_language = np.bincount(path, weights=known, minlength=len(languages))
            names.append(languages[int(by_language.argmax())])
            shares.append(float(by_language.max() / total))
            runs.append(1 + int((path_of_words[1:] != path_of_words[:-1]).sum()))
            spans.append(self.spans(text, path, letters) if with_spans else [])
        return names, shares, runs, spans

    def spans(self, text: str, path: np.ndarray, letters: np.ndarray) -> list[dict]:
        """Begin, end (exclusive, in characters) and language of each run of words."""
        out: list[dict] = []
        for match, state, n in zip(re.finditer(r"\S+", text), path.tolist(), letters.tolist()):
            if n and out and out[-1]["lang"] == self.model.languages[state]:
                out[-1]["end"] = match.end()
            elif n:
                out.append({"begin": match.start(), "end": match.end(), "lang": self.model.languages[state]})
        return out


def label(
    docs: DataFrame,
    model: Model,
    text: str = "text",
    keep: list[str] | None = None,
    with_spans: bool = True,
    penalty: float = PENALTY,
) -> DataFrame:
    """Add lang_pred, score, n_spans and, if asked for, the spans of a text column."""
    # Buckets x languages, whatever the corpus. Plain values: workers unpickle them without this package.
    shared = docs.sparkSession.sparkContext.broadcast((model.languages, model.scores, model.allowed))
    digest = (zlib.crc32(model.scores.tobytes()), tuple(model.languages), penalty)
    span = StructType(
        [StructField("begin", IntegerType()), StructField("end", IntegerType()), StructField("lang", StringType())]
    )
    kind = pa.list_(pa.struct([("begin", pa.int32()), ("end", pa.int32()), ("lang", pa.string())]))

    def start():
        labeller = once(("language", digest), lambda: Labeller(Model(*shared.value), penalty))

        def work(texts):
            names, shares, runs, spans = labeller.label(texts, with_spans)
            made = [pa.array(names, pa.string()), pa.array(shares, pa.float64()), pa.array(runs, pa.int64())]
            return [*made, pa.array(spans, kind)] if with_spans else made

        return work

    fields = [
        StructField("lang_pred", StringType()),
        StructField("score", DoubleType()),
        StructField("n_spans", LongType()),
    ]
    if with_spans:
        fields.append(StructField("spans", ArrayType(span)))
    return annotate(docs, fields, start, text, keep)


ship(__name__)
