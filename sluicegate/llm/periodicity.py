"""Periodic runs of words by recompression: a run-length grammar and exact extensions on it.

A *run* is a stretch of words with smallest period q, at least ``least`` times q and ``shortest`` words long, that
no neighbouring word extends keeping the period.

*Grammar.* The words of a batch of texts, as numbers, are one sequence with a symbol of its own before and after
every text. Levels alternate: block compression makes one symbol of each maximal block of equal symbols (the same
one for equal blocks), pair compression splits the alphabet in two and makes one symbol of every pair of a left and
a right symbol. Equal symbols stand for equal words, and equal stretches get the same symbols but for a few at their
ends. Separators are never paired, so the levels end when every text is one symbol. Blocks and pairs are named by
sorting them; there is no suffix array.

*Extensions.* How far the words from i and from j agree is found by walking both places through the levels: up while
both start the same symbol, along while symbols are equal (through a block in one step), down at a difference, until
words differ. The number of steps follows the levels, not the length. All pairs of a batch walk together.

*Candidates.* A run of period p has two equal words p apart at some multiple of ``max(shortest, least * p) - p``
counted from the text's start, so these places (a harmonic sum over all p) are all that is looked at. Equal pairs are
extended to both sides. Periods come in octaves: a pair inside a known run whose period divides p would give the same
run again and is left out. Of equal stretches the smallest period counts.

Null texts count as empty: no runs, an empty ``collapsed``. Repeated rows stay. Very long texts are rows like others:
memory per task is 1 MB of texts (or one longer text) and its grammar, some 200 bytes a word. Empty tables give
empty results. Other columns may have any names; those of added columns give way. No row is moved.
"""

from __future__ import annotations

from collections import defaultdict
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StringType, StructField, StructType

from sluicegate.llm.common import annotate, sheltered, ship

LEAST = 4
SHORTEST = 6
BATCH_BYTES = 1 << 20
RUN = StructType([StructField(name, LongType(), False) for name in ("start", "length", "period")])


class Grammar:
    """All levels of a sequence in one array each: places of level 0 are those of the sequence.

    sym: a node's symbol. up: its parent, -1 on the last level. down: its first child. rest, back: the number of
    equal symbols from the node to its block's end, and to its start.
    """

    def __init__(self, symbols: np.ndarray, separators: int):
        """Symbols below ``separators`` occur once each and are never paired."""
        self.separators = separators
        self.names = int(symbols.max()) + 1
        self.levels: list[tuple[np.ndarray, np.ndarray]] = []  # symbols, and the first children of each level
        now, children, turn = symbols.astype(np.int64), np.zeros(0, dtype=np.int64), 0
        self.levels.append((now, children))
        while True:
            neighbours = (now[1:] >= separators) & (now[:-1] >= separators)
            if not neighbours.any():
                break
            for made in (self._blocks(now), None):
                if made is None:
                    made = self._pairs(now, turn)
                    turn += 1
                if made is not None:
                    self.levels.append(made)
                    now = made[0]
        self._join()

    def _named(self, keys: np.ndarray) -> np.ndarray:
        """New symbols, the same for equal keys."""
        different, place = np.unique(keys, return_inverse=True)
        first = self.names
        self.names += len(different)
        return first + place

    def _blocks(self, now: np.ndarray) -> tuple[np.ndarray, np.ndarray] | None:
        begin = np.flatnonzero(np.append(True, now[1:] != now[:-1]))
        size = np.diff(np.append(begin, len(now)))
        if len(begin) == len(now):
            return None
        made = now[begin]
        many = size > 1
        made[many] = self._named(made[many] << 32 | size[many])
        return made, begin

    def _pairs(self, now: np.ndarray, turn: int) -> tuple[np.ndarray, np.ndarray] | None:
        mixed = (now + 1 + turn) * np.int64(0x2545F4914F6CDD1D)
        side = (mixed >> 40) & 1
        side[now < self.separators] = 2
        left_first = (side[:-1] == 0) & (side[1:] == 1)
        right_first = (side[:-1] == 1) & (side[1:] == 0)
        chosen = left_first if left_first.sum() >= right_first.sum() else right_first
        place = np.flatnonzero(chosen)
        if not len(place):
            return None
        made = now.copy()
        made[place] = self._named(now[place] << 32 | now[place + 1])
        stays = np.ones(len(now), dtype=bool)
        stays[place + 1] = False
        begin = np.flatnonzero(stays)
        return made[begin], begin

    def _join(self) -> None:
        sizes = [len(symbols) for symbols, _ in self.levels]
        start = np.cumsum([0, *sizes])
        self.words = sizes[0]
        self.sym = np.concatenate([symbols for symbols, _ in self.levels]).astype(np.int32)
        up, down, rest, back = (np.empty(start[-1] + 1, dtype=np.int32) for _ in range(4))
        up[start[-2] :] = -1
        down[: sizes[0]] = -1
        for level, (symbols, children) in enumerate(self.levels):
            lo, hi = start[level], start[level + 1]
            begin = np.flatnonzero(np.append(True, symbols[1:] != symbols[:-1]))
            size = np.diff(np.append(begin, len(symbols)))
            back[lo:hi] = np.arange(len(symbols)) - np.repeat(begin, size) + 1
            rest[lo:hi] = np.repeat(size, size) + 1 - back[lo:hi]
            if level:
                below = start[level - 1]
                down[lo:hi] = below + children
                up[below:lo] = lo + np.repeat(
                    np.arange(len(children)), np.diff(np.append(children, sizes[level - 1]))
                )
        # A node's last child stands before the next node's first one, across levels, too.
        down[-1] = start[-2]
        self.up, self.down, self.rest, self.back = up, down, rest, back
        self.levels = []

    def extend(self, x: np.ndarray, y: np.ndarray, forward: bool) -> np.ndarray:
        """How many words from the places x and y on (or back) agree. No x is its y."""
        sym, up, down = self.sym, self.up, self.down
        length, step = (self.rest, 1) if forward else (self.back, -1)
        result = np.zeros(len(x), dtype=np.int64)
        row, from_x = np.arange(len(x)), x
        while len(row):
            above_x, above_y = up[x], up[y]
            # Only an index here: on the last level the comparison is discarded.
            same_above = (sym[above_x] == sym[above_y]) & (above_x >= 0)
            if forward:
                ends = (down[above_x] == x) & (down[above_y] == y)
            else:
                ends = (down[above_x + 1] == x + 1) & (down[above_y + 1] == y + 1)
            climb = same_above & ends
            along = (sym[x] == sym[y]) & ~climb
            fall = ~(climb | along)
            done = fall & (x < self.words)
            result[row[done]] = np.abs(x[done] - from_x[row[done]])
            move = np.where(along, step * np.minimum(length[x], length[y]), 0)
            if forward:
                below_x, below_y = down[x], down[y]
            else:
                below_x, below_y = down[x + 1] - 1, down[y + 1] - 1
            x = np.where(climb, above_x, np.where(along, x + move, below_x))[~done]
            y = np.where(climb, above_y, np.where(along, y + move, below_y))[~done]
            row = row[~done]
        return result


def octave(begin: np.ndarray, size: np.ndarray, low: int, least: int, shortest: int) -> tuple[np.ndarray, np.ndarray]:
    """Places and periods to look at, for the periods from ``low`` to below twice that, of texts of given sizes."""
    most = np.minimum(size // least, 2 * low - 1)
    most[size < shortest] = 0
    texts = np.flatnonzero(most >= low)
    number = most[texts] - low + 1
    text = np.repeat(texts, number)
    period = low + np.arange(len(text)) - np.repeat(np.cumsum(number) - number, number)
    step = np.maximum(shortest, least * period) - period
    places = -(-(size[text] - period) // step)
    grid = np.arange(int(places.sum())) - np.repeat(np.cumsum(places) - places, places)
    return np.repeat(begin[text], places) + grid * np.repeat(step, places), np.repeat(period, places)


def runs_of(symbols: np.ndarray, begin: np.ndarray, size: np.ndarray, least: int, shortest: int) -> np.ndarray:
    """Start, length and period of all runs of a sequence of texts, by start, then period.

    ``begin`` and ``size`` are the texts' places; each stands between separators, the lowest symbols.
    """
    found = np.zeros((0, 3), dtype=np.int64)
    grammar = None
    reach, inside = np.zeros(len(symbols), dtype=np.int64), np.ones(len(symbols), dtype=np.int64)
    low = 1
    while low * least <= int(size.max(initial=0)):
        place, period = octave(begin, size, low, least, shortest)
        low *= 2
        equal = symbols[place] == symbols[place + period]
        place, period = place[equal], period[equal]
        known = (reach[place] > place + period) & (period % inside[place] == 0)
        place, period = place[~known], period[~known]
        if not len(place):
            continue
        grammar = grammar or Grammar(symbols, len(begin) + 1)
        start = place - grammar.extend(place - 1, place + period - 1, forward=False)
        length = place + period + grammar.extend(place, place + period, forward=True) - start
        good = length >= np.maximum(shortest, least * period)
        new = np.stack([start[good], length[good], period[good]], axis=1)
        if len(new):
            found = np.concatenate([found, new])
            found = found[np.lexsort((found[:, 2], found[:, 1], found[:, 0]))]
            stretch = found[:, :2]
            found = found[np.append(True, (stretch[1:] != stretch[:-1]).any(axis=1))]
            for first, words, q in found[np.argsort(found[:, 1], kind="stable")].tolist():
                reach[first : first + words], inside[first : first + words] = first + words, q
    return found[np.lexsort((found[:, 2], found[:, 0]))]


def collapse(texts: list[str | None], least: int, shortest: int) -> tuple[list[np.ndarray], list[bytes]]:
    """Of each text the runs (start, length, period), and the words that no run repeats, joined by a space."""
    number_of = defaultdict(count(len(texts) + 1).__next__)
    words = [(text or "").encode().split() for text in texts]
    size = np.array([len(found) for found in words], dtype=np.int64)
    begin = np.cumsum(size + 1) - size
    symbols = np.empty(int((size + 1).sum()) + 1, dtype=np.int64)
    symbols[np.append(begin - 1, len(symbols) - 1)] = np.arange(len(texts) + 1)
    for first, found in zip(begin.tolist(), words):
        symbols[first : first + len(found)] = np.fromiter(map(number_of.__getitem__, found), np.int64, len(found))
    runs = runs_of(symbols, begin, size, least, shortest)
    text = np.searchsorted(begin, runs[:, 0], side="right") - 1
    runs[:, 0] -= begin[text]
    ends = np.searchsorted(text, np.arange(len(texts) + 1))
    each = [runs[a:b] for a, b in zip(ends[:-1].tolist(), ends[1:].tolist())]
    kept = []
    for found, of_text in zip(words, each):
        if len(of_text):
            stays = np.ones(len(found), dtype=bool)
            for first, length, period in of_text.tolist():
                stays[first + period : first + length] = False
            found = [word for word, stay in zip(found, stays.tolist()) if stay]
        kept.append(b" ".join(found))
    return each, kept


def find_runs(
    docs: DataFrame,
    text: str = "text",
    keep: list[str] | None = None,
    least: int = LEAST,
    shortest: int = SHORTEST,
) -> DataFrame:
    """Add ``runs`` (start, length, period in words, by start, then period) and ``collapsed`` of a text column.

    ``collapsed`` has the words but those that a run holds after its first period.
    """
    if least < 2 or shortest < 2:
        raise ValueError("a run holds its period twice")

    def start():
        def work(texts):
            each, kept = collapse(texts, least, shortest)
            ends = np.cumsum([0] + [len(found) for found in each]).astype(np.int32)
            flat = np.concatenate(each) if each else np.zeros((0, 3), dtype=np.int64)
            fields = [pa.field(name, pa.int64(), False) for name in RUN.names]
            rows = pa.StructArray.from_arrays([pa.array(flat[:, n]) for n in range(3)], fields=fields)
            return [pa.ListArray.from_arrays(pa.array(ends), rows), pa.array(kept, pa.string())]

        return work

    fields = [StructField("runs", ArrayType(RUN, False)), StructField("collapsed", StringType())]

    def work(frame: DataFrame, names: dict[str, str]) -> DataFrame:
        kept = [names[c] for c in (docs.columns if keep is None else keep)]
        return annotate(frame, fields, start, names[text], kept, BATCH_BYTES)

    return sheltered(docs, work, keep, (text,))


def strongest(runs: Column) -> Column:
    """The run with the greatest length by period; of equals the one with the smallest start, then period."""
    empty = F.lit(None).cast(RUN)

    def better(one: Column, other: Column) -> Column:
        greater = other["length"] * one["period"] > one["length"] * other["period"]
        return F.when(one.isNull() | greater, other).otherwise(one)

    return F.reduce(runs, empty, better)


ship(__name__)
