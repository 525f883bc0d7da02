"""Quality rules with thresholds that follow each language and source.

Counts come from whole texts, row by row. A text that fails the fixed base rules goes. For the rest, each share
(symbols, punctuation, capitals, repeated words, repeated lines, word length) is compared with the fences of its
own language and source: quartiles widened by ``REACH`` times their distance. The quartiles are read from
sketches: counts of shares in buckets, exact up to 64 and within 3 % beyond, as in an HDR histogram. Sketches
merge by adding counts, in any order and with the same result, so

- a task sends one row per bucket it has seen, whatever the number of its rows;
- a source with less than ``LEAST_ROWS`` rows takes the merged sketch of its language, a small language that of
  all texts.

The fences, a row per language and source, are then joined with the counts; the texts don't move.

Null texts have no words; texts without words fail the base rules and enter no sketch. Null languages and
sources are groups of their own. Repeated rows count and stay each. Very long texts are rows like others: memory per
task is one text, its words and a hash per window. Empty tables give empty results. Other columns may have any names;
those of added columns give way.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sluicegate.llm.common import sheltered
from sluicegate.session import stored

LEAST_WORDS = 10
MOST_REPEATED = 20  # percent of the words
WINDOW = 5
REACH = 6
LEAST_ROWS = 200
# Name, and the least distance between quartiles and fence; shares in ten-thousandths, word length in hundredths.
SHARES = {
    "symbols": 300,
    "punctuation": 600,
    "capitals": 800,
    "repeats": 1500,
    "dup_lines": 2500,
    "word_length": 400,
}
SPACES = r"[\x20\x09-\x0D]+"


def _let(value: Column, body) -> Column:
    """Compute a value once for all its uses in lambdas."""
    return F.get(F.transform(F.array(value), body), 0)


def _covered(windows: Column) -> Column:
    """How many words lie in windows that occur twice or more, given the windows' hashes."""
    numbered = F.array_sort(F.transform(windows, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

    def repeated(s: Column) -> Column:
        def place(x: Column, k: Column) -> Column:
            same = (F.get(s, k - 1)["h"] == x["h"]) | (F.get(s, k + 1)["h"] == x["h"])
            return F.when(same, x["i"])

        return F.array_sort(F.array_compact(F.transform(s, place)))

    def step(state: Column, i: Column) -> Column:
        end = i + WINDOW
        return F.struct((state["n"] + end - F.greatest(i, state["upto"])).alias("n"), end.alias("upto"))

    start = F.struct(F.lit(0).alias("n"), F.lit(0).alias("upto"))
    return F.aggregate(_let(numbered, repeated), start, step, lambda state: state["n"])


def add_counts(docs: DataFrame, keep: list[str], text: str = "text") -> DataFrame:
    """The columns ``keep``, the counts of a text column, and base_failed."""
    value = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    split = docs.select(
        *[f"`{c}`" for c in keep],
        F.array_remove(F.split(value, SPACES), "").alias("row words"),
        F.filter(F.split(value, "\n"), lambda line: line.rlike(r"[^\x20\x09-\x0D]")).alias("row lines"),
        F.length(F.regexp_replace(value, r"[^#*$%&|<>]+", "")).cast("long").alias("n_symbols"),
        F.length(F.regexp_replace(value, r"[^!-/:-@\[-`{-~]+", "")).cast("long").alias("n_punctuation"),
        F.length(F.regexp_replace(value, r"[^A-Z]+", "")).cast("long").alias("n_capitals"),
    )
    words = F.col("row words")
    positions = F.sequence(F.lit(1), F.size(words) - (WINDOW - 1))
    hashed = F.transform(positions, lambda i: F.xxhash64(F.slice(words, i, WINDOW)))
    windows = F.when(F.size(words) >= WINDOW, hashed).otherwise(F.array().cast("array<bigint>"))
    fixed = ["n_symbols", "n_punctuation", "n_capitals"]
    counted = split.select(
        *[f"`{c}`" for c in keep],
        F.size(words).cast("long").alias("n_words"),
        F.length(F.array_join(words, "")).cast("long").alias("word_chars"),
        *fixed,
        F.size("row lines").cast("long").alias("n_lines"),
        (F.size("row lines") - F.size(F.array_distinct("row lines"))).cast("long").alias("n_dup_lines"),
        windows.alias("windows"),
    )
    has_repeats = F.size("windows") > F.size(F.array_distinct("windows"))
    repeated = F.when(has_repeats, _covered(F.col("windows"))).otherwise(0).cast("long")
    failed = (F.col("n_words") < LEAST_WORDS) | (
        100 * F.col("n_repeat_words") > MOST_REPEATED * F.col("n_words")
    )
    return (
        counted.withColumn("n_repeat_words", repeated).drop("windows").withColumn("base_failed", failed)
    )


def _share(part: str, of: str, scale: int) -> Column:
    return F.expr(f"({scale} * {part}) div greatest({of}, 1)")


def _shares() -> dict[str, Column]:
    return {
        "symbols": _share("n_symbols", "word_chars", 10_000),
        "punctuation": _share("n_punctuation", "word_chars", 10_000),
        "capitals": _share("n_capitals", "word_chars", 10_000),
        "repeats": _share("n_repeat_words", "n_words", 10_000),
        "dup_lines": _share("n_dup_lines", "n_lines", 10_000),
        "word_length": _share("word_chars", "n_words", 100),
    }


def bucket(value: Column) -> Column:
    """The least value of a number's bucket: exact below 64, else its six leading binary digits."""
    extra = F.greatest(F.length(F.bin(value)) - 6, F.lit(0))
    return F.call_function("shiftleft", F.call_function("shiftright", value, extra), extra)


def sketches(counted: DataFrame, lang: str, source: str) -> DataFrame:
    """language, origin, share, bucket, n: the mergeable sketches of every language and source."""
    made = F.array(
        *[F.struct(F.lit(name).alias("share"), bucket(value).alias("bucket")) for name, value in _shares().items()]
    )
    exploded = counted.filter("n_words > 0").select(
        _name(lang).alias("language"), _name(source).alias("origin"), F.explode(made).alias("x")
    )
    return exploded.groupBy("language", "origin", "x.share", "x.bucket").agg(F.count("*").alias("n"))


def _name(column: str) -> Column:
    """A column as text in which null differs from every value."""
    return F.coalesce(F.concat(F.lit("="), F.col(f"`{column}`").cast("string")), F.lit("null"))


def _quartiles(cells: DataFrame, keys: list[str], prefix: str) -> DataFrame:
    merged = cells.groupBy(*keys, "share", "bucket").agg(F.sum("n").alias("n"))
    group = Window.partitionBy(*keys, "share")
    upto = F.sum("n").over(group.orderBy("bucket"))
    placed = merged.withColumn("upto", upto).withColumn("rows", F.sum("n").over(group))

    def at(quarter: int) -> Column:
        return F.min(F.when(4 * F.col("upto") >= quarter * F.col("rows"), F.col("bucket")))

    return placed.groupBy(*keys, "share").agg(
        F.first("rows").alias(f"{prefix}_rows"), at(1).alias(f"{prefix}_q1"), at(3).alias(f"{prefix}_q3")
    )


def fences(cells: DataFrame) -> DataFrame:
    """language, origin, share, low, high: what texts of a language and source may have."""
    own = _quartiles(cells, ["language", "origin"], "own")
    wider = _quartiles(cells, ["language"], "wider")
    whole = _quartiles(cells, [], "whole")
    together = own.join(wider, ["language", "share"]).join(whole, "share")

    def chosen(name: str) -> Column:
        return (
            F.when(F.col("own_rows") >= LEAST_ROWS, F.col(f"own_{name}"))
            .when(F.col("wider_rows") >= LEAST_ROWS, F.col(f"wider_{name}"))
            .otherwise(F.col(f"whole_{name}"))
        )

    least = F.coalesce(*[F.when(F.col("share") == name, F.lit(value)) for name, value in SHARES.items()])
    reach = F.greatest(REACH * (chosen("q3") - chosen("q1")), least)
    low = F.when(F.col("share") == "word_length", chosen("q1") - reach)
    return together.select("language", "origin", "share", low.alias("low"), (chosen("q3") + reach).alias("high"))


def judge(
    docs: DataFrame,
    keep: list[str] | None = None,
    text: str = "text",
    lang: str = "lang",
    source: str = "source",
) -> DataFrame:
    """The columns ``keep`` (all but the text), the counts, base_failed and kept.

    Kept columns that are named as a count give way to it.
    """
    kept = [c for c in (docs.columns if keep is None else keep) if c != text]

    def work(frame: DataFrame, names: dict[str, str]) -> DataFrame:
        return _judge(frame, [names[c] for c in kept], names[text], names[lang], names[source])

    return sheltered(docs, work, kept, (text, lang, source))


def _judge(docs: DataFrame, names: list[str], text: str, lang: str, source: str) -> DataFrame:
    named = docs.select(
        *[f"`{c}`" for c in names],
        F.col(f"`{lang}`").alias("language of the row"),
        F.col(f"`{source}`").alias("source of the row"),
        F.col(f"`{text}`").alias("text of the row"),
    )
    counted = stored(
        add_counts(named, [*names, "language of the row", "source of the row"], "text of the row"), "counts"
    )
    cells = stored(sketches(counted, "language of the row", "source of the row"), "sketches")
    limits = fences(cells).groupBy("language", "origin")
    wide = limits.agg(
        *[F.max(F.when(F.col("share") == name, F.col("high"))).alias(f"high {name}") for name in SHARES],
        F.max("low").alias("low word_length"),
    )
    within = F.col("low word_length") <= _shares()["word_length"]
    for name, value in _shares().items():
        within = within & (value <= F.col(f"high {name}"))
    joined = (
        counted.withColumn("language", _name("language of the row"))
        .withColumn("origin", _name("source of the row"))
        .join(stored(wide, "fences"), ["language", "origin"], "left")
    )
    kept = F.coalesce(~F.col("base_failed") & within, F.lit(False))
    added = [c for c in counted.columns if c not in names and not c.endswith("of the row")]
    return joined.select(*[f"`{c}`" for c in names], *added, kept.alias("kept"))
