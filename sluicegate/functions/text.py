"""Text rules as column expressions; all of them stay inside the JVM."""

from __future__ import annotations

import re
import sys
import unicodedata
from collections.abc import Callable
from functools import lru_cache

from pyspark.sql import Column
from pyspark.sql import functions as F

from sluicegate import fixed_values as fv
from sluicegate.functions.portable import portable

# What Python calls whitespace, spelled out: Java's \s and Spark's trim know fewer characters.
SPACE_RANGES = r"\t-\r\x1c-\x20\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
SPACE = f"[{SPACE_RANGES}]"
SPACE_CHARS = "".join(chr(p) for p in range(0x3001) if chr(p).isspace())
# Same for text that is already ASCII.
ASCII_SPACE = r"[\t-\r\x1c-\x20]"
ASCII_SPACE_BUT_BLANK = r"[\t-\r\x1c-\x1f]"


def java_pattern(pattern: str, ignore_case: bool = False) -> str:
    """A Python pattern with the same meaning for Java: only newline ends a line, Unicode classes."""
    flags = "(?idU)" if ignore_case else "(?dU)"
    return flags + pattern.replace(r"\s", SPACE)


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """Bind a costly value to a name, so that an expression may use it more than once and still
    compute it once per row."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def pinned(value: Column) -> Column:
    """The value as a column that the optimizer never writes out again where it is used.

    Projections are merged only if their expressions are deterministic, which a partition's number isn't for it.
    A Python call gets its argument as a plain column then, whatever lambdas computed it.
    """
    return F.when(F.spark_partition_id() >= 0, value)


def strip(text: Column) -> Column:
    """Remove leading and trailing whitespace of any kind."""
    return F.btrim(text, F.lit(SPACE_CHARS))


def words(text: Column) -> Column:
    """Whitespace-separated words."""
    return F.array_remove(F.split(text, f"{SPACE}+"), "")


def first_words(text: Column, limit: int) -> Column:
    """The first words of a text; the rest of it is not split."""
    pieces = F.split(F.ltrim(text, F.lit(SPACE_CHARS)), f"{SPACE}+", limit + 1)
    return F.array_remove(F.slice(pieces, 1, limit), "")


def word_count(text: Column) -> Column:
    return F.size(words(text))


def preview(text: Column, chars: int = fv.PREVIEW_CHARS) -> Column:
    return F.when(
        F.length(text) > chars, F.concat(F.substring(text, 1, chars), F.lit("..."))
    ).otherwise(text)


# -- normalisation ----------------------------------------------------------


def unleet(text: Column) -> Column:
    return F.translate(text, fv.LEET_FROM, fv.LEET_TO)


@lru_cache(maxsize=1)
def _ascii_folds() -> tuple[dict[str, str], dict[str, str]]:
    """Characters whose compatibility decomposition leaves one, or several, ASCII characters."""
    single, several = {}, {}
    for point in range(0x80, sys.maxunicode + 1):
        char = chr(point)
        if unicodedata.category(char) == "Cs":
            continue
        kept = "".join(c for c in unicodedata.normalize("NFKD", char) if c < "\x80")
        if len(kept) == 1:
            single[char] = kept
        elif kept:
            several[char] = kept
    return single, several


def _spans(chars: dict[str, str], gap: int = 64) -> str:
    """A regex class that covers the characters by a few ranges, and some others between them."""
    spans: list[list[int]] = []
    for point in sorted(map(ord, chars)):
        if spans and point - spans[-1][1] <= gap:
            spans[-1][1] = point
        else:
            spans.append([point, point])
    ranges = "".join(f"\\x{{{low:X}}}-\\x{{{high:X}}}" for low, high in spans)
    return f"[\\x{{80}}-\\x{{10FFFF}}&&[{ranges}]]"


def fold_ascii(text: Column, first_from: str = "", first_to: str = "") -> Column:
    """Compatibility-decompose and keep only ASCII.

    Decomposition works character by character and combining marks are dropped anyway, so a
    per-character table is exact. Texts that are ASCII already skip all of it. Character
    replacements that go before the folding can share its pass.
    """
    single, several = _ascii_folds()
    singles = {**single, **dict(zip(first_from, first_to))}
    one = F.translate(text, "".join(singles), "".join(singles.values()))
    several_class = _spans(several)
    entries = "\ue001".join(f"{char}\ue002{kept}" for char, kept in several.items())
    table = F.str_to_map(F.lit(entries), F.lit("\ue001"), F.lit("\ue002"))
    # The marker is not ASCII, so one that stood in the text would be dropped below all the same.
    marked = F.regexp_replace(one, f"({several_class})", "\ue000$1\ue000")
    pieces = F.transform(
        F.split(marked, "\ue000"), lambda piece: F.coalesce(F.try_element_at(table, piece), piece)
    )
    folded = F.when(text.rlike(several_class), F.array_join(pieces, "")).otherwise(one)
    plain = F.translate(text, first_from, first_to) if first_from else text
    return F.when(
        text.rlike(r"[^\x00-\x7F]"), F.regexp_replace(folded, r"[^\x00-\x7F]+", "")
    ).otherwise(plain)


def blank_separators(text: Column) -> Column:
    # Replaced one by one: translate makes a string of every character.
    for separator in "_-.":
        text = F.replace(text, F.lit(separator), F.lit(" "))
    return text


def split_camel(text: Column) -> Column:
    # The capital first: it is rare, so most places need no look behind.
    return F.regexp_replace(text, "[A-Z](?<=[a-z].)", " $0")


def join_letters(text: Column) -> Column:
    r"""Close up spelled-out words: drop the blanks between single characters.

    Where every gap is one character wide, looking one character around a blank is enough.
    Otherwise a match starts at a single character, or goes on (\G) inside the gap the last
    match ended in, so a gap of any length and any mix of whitespace is handled in one pass.
    """
    char, no_char = "[a-zA-Z0-9]", "(?![a-zA-Z0-9])"
    lone = f"(?<!{char}){char}"
    wide = (
        rf"((?:{lone}|\G(?!\A)){ASCII_SPACE_BUT_BLANK}*+) (?={ASCII_SPACE}*+{char}{no_char})"
    )

    def join(value: Column) -> Column:
        return F.when(
            value.rlike(f"{ASCII_SPACE}{{2}}"), F.regexp_replace(value, wide, "$1")
        ).otherwise(F.regexp_replace(value, f" (?<={lone} )(?={char}{no_char})", ""))

    return let(text, join)


def collapse_stutter(text: Column) -> Column:
    return F.regexp_replace(text, r"(?d)(.)\1{2,}", "$1")


def normalize(text: Column) -> Column:
    """The whole normaliser; the order of the steps is part of its meaning."""
    text = fold_ascii(text, fv.LEET_FROM, fv.LEET_TO)
    return collapse_stutter(join_letters(split_camel(blank_separators(text))))


def normal_tokens(text: Column) -> Column:
    """Lower-case tokens of a normalised text, in order, with repeats."""
    return F.array_remove(F.split(F.lower(text), "[^a-z0-9]+"), "")


def tokens(text: Column) -> Column:
    return normal_tokens(normalize(text))


CAMEL = re.compile("[A-Z](?<=[a-z][A-Z])")
STUTTER = re.compile(r"(.)\1{2,}")


def token_folds() -> dict[int, str]:
    """What the normaliser leaves of a character, as far as tokens are concerned.

    That is letters and digits, blanks, and line ends for all else that stands between tokens. Characters without
    an entry beyond ASCII are dropped.
    """
    single, several = _ascii_folds()
    folds = {chr(point): chr(point) for point in range(128)} | single | several | dict(zip(fv.LEET_FROM, fv.LEET_TO))
    blanks = str.maketrans("_-.", "   ")

    def kept(text: str) -> str:
        return "".join(c if c.isalnum() or c == " " else "\n" for c in text.translate(blanks))

    return {ord(char): kept(text) for char, text in folds.items()}


@portable
class Tokenizer:
    """The tokens of ``tokens``, in a worker."""

    def __init__(self, folds: dict[int, str]):
        self.latin = bytes(ord(folds[i]) if len(folds.get(i, "")) == 1 else i for i in range(256))
        self.dropped = bytes(i for i in range(256) if i not in folds)
        self.several = [(bytes([i]), folds[i].encode()) for i in range(256) if len(folds.get(i, "")) > 1]
        self.other = dict(folds)

    def line(self, text: str) -> str:
        try:
            data = text.encode("latin-1").translate(self.latin, self.dropped)
            for char, kept in self.several:
                data = data.replace(char, kept)
            line = data.decode("ascii")
        except UnicodeEncodeError:
            for char in set(text).difference(map(chr, self.other)):
                self.other[ord(char)] = ""
            line = text.translate(self.other)
        return CAMEL.sub(r" \g<0>", line)

    def raw(self, text: str) -> list[str]:
        """The different words of a normalised text, in order, but for case and stutter."""
        found: dict[str, None] = {}
        for part in self.line(text).split("\n"):
            # Single characters with nothing but blanks between them are a spelled-out word.
            spelled = ""
            for word in part.split():
                if len(word) == 1:
                    spelled += word
                    continue
                if spelled:
                    found[spelled] = None
                    spelled = ""
                found[word] = None
            if spelled:
                found[spelled] = None
        return list(found)

    @staticmethod
    def token(raw: str) -> str:
        return STUTTER.sub(r"\1", raw).lower()


# -- sentences --------------------------------------------------------------


def sentences(text: Column) -> Column:
    return F.split(text, "(?<=[.!?]) +")


def sentence_chunks(text: Column, limit: int = fv.WORDS_PER_CHUNK) -> Column:
    """Sentences, the overlong ones cut into word chunks, stripped, empty ones dropped."""

    def cut(sentence: Column) -> Column:
        parts = words(sentence)
        starts = F.sequence(F.lit(0), F.size(parts) - 1, F.lit(limit))
        chunks = F.transform(starts, lambda at: F.array_join(F.slice(parts, at + 1, limit), " "))
        # More than ``limit`` words need at least two characters each, but for the last.
        return F.when((F.length(sentence) > 2 * limit) & (F.size(parts) > limit), chunks).otherwise(
            F.array(sentence)
        )

    return F.filter(
        F.transform(F.flatten(F.transform(sentences(text), cut)), strip),
        lambda chunk: chunk != "",
    )


# What ``sentences`` splits at; the blank stands first, so that most places need no look behind.
SENTENCE_GAP = re.compile(" (?<=[.!?] ) *")


@portable
def chunk_list(text: str, limit: int) -> list[str]:
    """``sentence_chunks`` of a text, in a worker."""
    found = []
    for sentence in SENTENCE_GAP.split(text):
        # More than ``limit`` words need at least two characters each, but for the last.
        words = sentence.split() if len(sentence) > 2 * limit else ()
        if len(words) > limit:
            found += [" ".join(words[at : at + limit]) for at in range(0, len(words), limit)]
        else:
            found.append(sentence.strip())
    return [chunk for chunk in found if chunk]


# -- cleaning ---------------------------------------------------------------


def clean_suffix(text: Column) -> Column:
    """Remove a trailing '. Example N.' and surrounding whitespace."""
    return strip(F.regexp_replace(text, java_pattern(fv.EXAMPLE_SUFFIX), ""))


def strip_intent(text: Column) -> Column:
    """Remove attack phrases; a text without any is returned untouched."""
    cleaned = text
    for pattern in fv.INTENT_PATTERNS:
        cleaned = F.regexp_replace(cleaned, java_pattern(pattern, ignore_case=True), "")
    return let(cleaned, lambda rest: F.when(rest != text, strip(rest)).otherwise(text))


# Every match of a pattern holds one of these; of other characters than the letters themselves only those below count
# as equal to a letter if case is ignored, beyond what lower case says.
INTENT_NEEDLES = ("ignore ", "act as ", "fictional story", "developer mode", "refuse", "hypothetically")
OTHER_CASES = re.compile("[\u017f\u0130\u0131]")
INTENTS = tuple(re.compile(pattern, re.IGNORECASE) for pattern in fv.INTENT_PATTERNS)


@portable
def stripped(text: str) -> str:
    """``strip_intent`` of a text, in a worker."""
    low = text.lower()
    if not any(needle in low for needle in INTENT_NEEDLES) and not OTHER_CASES.search(text):
        return text
    rest = text
    for pattern in INTENTS:
        rest = pattern.sub("", rest)
    return text if rest == text else rest.strip()
