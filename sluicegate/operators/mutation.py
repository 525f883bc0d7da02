"""Seeded variants of a prompt, and the risk consensus over them."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import arrow_udf

from sluicegate import fixed_values as fv
from sluicegate.functions import embedding as em
from sluicegate.functions import text as tx
from sluicegate.functions.draws import LOW_BITS, MODULUS, draw, seed_of, stream
from sluicegate.functions.portable import portable
from sluicegate.functions.similarity import common_length
from sluicegate.functions.text import stripped
from sluicegate.operators.joins import dimension_join, is_small, localized
from sluicegate.session import dimension

SYNONYM_SCHEMA = "word string, synset_id int, lemma string"
SYNONYM_MAP_ROWS = 2000
WORD_DRAWS = 10
SWAPS = 2
# Numbers a single draw may use: slot, template or place, word places, synonym choices.
NUMBERS = 2 + WORD_DRAWS + SWAPS
STREAMS = fv.MUTATION_DRAWS * NUMBERS
# Prompts that a worker has as Python strings at a time, and characters of their variants; one prompt more may go beyond.
PROMPTS_PER_STEP = 256
CHARS_PER_STEP = 1 << 21
# Bytes of the prompts whose variants come back at a time; one prompt more may go beyond.
BYTES_PER_BATCH = 1 << 19

# A few synonym sets to work without a thesaurus; a larger table is passed in as a DataFrame.
SYNONYM_SETS = (
    ("with", "along_with", "alongside"),
    ("this", "the_present", "the_said"),
    ("from", "out_of", "starting_at"),
    ("that", "which", "the_one_that"),
    ("than", "as_compared_to"),
    ("then", "afterwards", "next"),
    ("instructions", "directions", "guidelines"),
    ("rules", "guidelines", "regulations"),
    ("write", "compose", "pen"),
    ("tell", "inform", "say_to"),
    ("story", "tale", "narrative"),
    ("previous", "prior", "earlier"),
    ("ignore", "disregard", "neglect"),
    ("website", "site", "web_site"),
    ("hack", "break_into", "cut_up"),
    ("dans", "dedans", "parmi"),
    ("pour", "afin_de"),
    ("nicht", "keineswegs"),
)


def synonym_rows() -> list[tuple[str, int, str]]:
    return [
        (word, i, lemma) for i, lemmas in enumerate(SYNONYM_SETS) for word in lemmas for lemma in lemmas
    ]


def default_synonyms(spark: SparkSession) -> DataFrame:
    """word, synset_id, lemma: the sets every word belongs to, with their members."""
    rows = {(w.replace("_", " "), i, lemma) for w, i, lemma in synonym_rows()}
    return dimension(spark, sorted(rows), SYNONYM_SCHEMA)


def synonym_lookup(words: DataFrame, synonyms: DataFrame) -> DataFrame:
    """word, synonym: every other member of the word's sets, underscores as blanks, distinct."""
    members = synonyms.select(
        F.lower("word").alias("looked_up"), F.translate("lemma", "_", " ").alias("synonym")
    ).filter(F.lower("synonym") != F.col("looked_up")).distinct()
    found = dimension_join(
        words.select("word", F.lower("word").alias("looked_up")),
        members,
        "looked_up",
        "inner",
        F.col("word"),
    )
    return found.select("word", "synonym").distinct()


def _synonym_lists(synonyms: DataFrame) -> DataFrame:
    """word, choices: the sorted synonyms of each known word."""
    return (
        synonym_lookup(synonyms.select(F.lower("word").alias("word")).distinct(), synonyms)
        .groupBy("word")
        .agg(F.array_sort(F.collect_set("synonym")).alias("choices"))
    )


# -- single strategies ------------------------------------------------------


def wrap(prompt: Column, template: Column) -> Column:
    """The template's prefix put before the prompt; templates count from 0."""
    return F.concat(F.get(F.array(*map(F.lit, fv.WRAP_PREFIXES)), template), prompt)


def swap_letters(prompt: Column, place: Column) -> Column:
    """Swap the characters at a place, counted from 0, and the next one; short prompts stay."""
    one = F.lit(1)
    swapped = F.concat(
        F.substring(prompt, F.lit(1), place),
        F.substring(prompt, place + 2, one),
        F.substring(prompt, place + 1, one),
        F.substring(prompt, place + 3, F.length(prompt)),
    )
    return F.when(F.length(prompt) < 5, prompt).otherwise(swapped)


def _number(start: Column, turn: Column, j: Column | int, below: Column) -> Column:
    return draw(start, turn * NUMBERS + j, below, STREAMS)


def synonym_picks(words: Column, choices: Column, start: Column, turn: Column) -> Column:
    """array(place, letters, text): up to two drawn words and the synonym that replaces each.

    ``choices`` maps a lower-case word to its synonyms. Ten words are drawn; the first two that
    have more than three letters and a synonym are replaced. Short prompts stay as they are.
    """

    def look_up(j: Column) -> Column:
        place = _number(start, turn, j + 2, F.size(words))
        word = F.get(words, place)
        return F.struct(
            place.alias("place"),
            F.length(word).alias("letters"),
            F.try_element_at(choices, F.lower(word)).alias("options"),
        )

    draws = F.when(F.size(words) >= 3, F.sequence(F.lit(0), F.lit(WORD_DRAWS - 1))).otherwise(
        F.array().cast("array<int>")
    )
    drawn = F.filter(
        F.transform(draws, look_up), lambda pick: (pick["letters"] > 3) & pick["options"].isNotNull()
    )
    return F.transform(
        F.slice(drawn, 1, SWAPS),
        lambda pick, k: F.struct(
            pick["place"].alias("place"),
            pick["letters"].alias("letters"),
            F.get(
                pick["options"], _number(start, turn, k + 2 + WORD_DRAWS, F.size(pick["options"]))
            ).alias("text"),
        ),
    )


def swapped_text(prompt: Column, words: Column, picks: Column) -> Column:
    """The prompt with the picked words replaced, re-joined by blanks."""

    def put(done: Column, pick: Column) -> Column:
        rest = F.slice(done, pick["place"] + 2, F.size(done))
        return F.concat(F.slice(done, F.lit(1), pick["place"]), F.array(pick["text"]), rest)

    return F.when(F.size(words) < 3, prompt).otherwise(
        F.array_join(F.aggregate(picks, words, put), " ")
    )


# -- variant generation -----------------------------------------------------


def _with_choices(prompts: DataFrame, synonyms: DataFrame) -> tuple[DataFrame, dict[str, list[str]] | None]:
    """The synonyms of the words that may be drawn: a table, or, as column choices_ beside each prompt, a map.

    A small thesaurus is the table. A large one is joined with the drawn words, at most 150 per prompt; only those
    words, not the texts, are matched with it.
    """
    lists = localized(_synonym_lists(localized(synonyms)), SYNONYM_MAP_ROWS)
    if is_small(lists, SYNONYM_MAP_ROWS):
        return prompts, {row["word"]: row["choices"] for row in lists.collect()}  # bounded by the check above
    return _with_joined_choices(prompts.withColumn("words_", tx.words(F.col("prompt"))), lists), None


def add_choices(prompts: DataFrame, synonyms: DataFrame) -> DataFrame:
    """Add words_ and choices_, a map from the words that may be drawn to their synonyms. Needs start_."""
    found, table = _with_choices(prompts, synonyms)
    if table is None:
        return found
    pairs = [x for word in sorted(table) for x in (F.lit(word), F.array(*[F.lit(c) for c in table[word]]))]
    choices = F.create_map(*pairs) if pairs else F.create_map().cast("map<string,array<string>>")
    return found.withColumn("words_", tx.words(F.col("prompt"))).withColumn("choices_", choices)


def _with_joined_choices(prompts: DataFrame, lists: DataFrame) -> DataFrame:
    turns = F.sequence(F.lit(0), F.lit(fv.MUTATION_DRAWS - 1))
    drawn = F.flatten(
        F.transform(
            turns,
            lambda turn: F.transform(
                F.sequence(F.lit(0), F.lit(WORD_DRAWS - 1)),
                lambda j: F.lower(
                    F.get(F.col("words_"), _number(F.col("start_"), turn, j + 2, F.size("words_")))
                ),
            ),
        )
    )
    used = prompts.filter(F.size("words_") > 2).select(
        "prompt_id", F.explode_outer(F.array_distinct(drawn)).alias("word")
    ).filter("word is not null")
    found = (
        dimension_join(used, lists, "word", "inner", F.col("prompt_id"))
        .groupBy("prompt_id")
        .agg(F.map_from_entries(F.collect_list(F.struct("word", "choices"))).alias("choices_"))
    )
    empty = F.create_map().cast("map<string,array<string>>")
    return prompts.join(found, "prompt_id", "left").withColumn(
        "choices_", F.coalesce("choices_", empty)
    )


@portable
class VariantMaker:
    """The variants of a prompt, from the numbers that a start value gives."""

    def __init__(self, slots: tuple[str, ...], prefixes: tuple[str, ...], steps: list, count: int, floor: float):
        self.slots, self.prefixes, self.steps, self.count, self.floor = slots, prefixes, steps, count, floor

    def number(self, start: int, step: int, below: int) -> int:
        """``draw`` of a start value."""
        a, c = self.steps[step]
        return ((start * a + c) % MODULUS >> LOW_BITS) % below

    def swap(self, prompt: str, words: list[str], choices: dict[str, list[str]], start: int, turn: int) -> str:
        """The prompt with the words of ``synonym_picks`` replaced, if that is similar enough to it."""
        at, picks = turn * NUMBERS, []
        for j in range(WORD_DRAWS):
            place = self.number(start, at + 2 + j, len(words))
            options = choices.get(words[place].lower()) if len(words[place]) > 3 else None
            if options:
                picks.append((place, options[self.number(start, at + 2 + WORD_DRAWS + len(picks), len(options))]))
                if len(picks) == SWAPS:
                    break
        done = list(words)
        for place, synonym in picks:
            done[place] = synonym
        text, letters = " ".join(done), sum(map(len, words))
        kept = letters - sum(len(words[place]) for place in {place for place, _ in picks})
        total = len(prompt) + len(text)
        # Unchanged words and gaps that hold a blank stand in both texts, in order; lengths bound the rest.
        if 200.0 * min(len(prompt), len(text)) / total < self.floor:
            return prompt
        other = len(prompt) - letters - prompt.count(" ")
        if 200.0 * (kept + max(len(words) - 1 - other, 0)) / total >= self.floor:
            return text
        runs = prompt.strip()
        for char in {char for char in runs if char.isspace()} - {" "}:
            runs = runs.replace(char, "\t")
        gaps = len(words) - 1 - sum(" " not in gap for gap in re.findall("[\t ]+", runs))
        if 200.0 * (kept + gaps) / total >= self.floor:
            return text
        return text if 200.0 * common_length(prompt, text) / total >= self.floor else prompt

    def swap_letters(self, prompt: str, start: int, turn: int) -> str:
        """A typo, if it is similar enough; short prompts stay."""
        size = len(prompt)
        if size < 5 or 100.0 * (size - 1) / size < self.floor:
            return prompt
        at = self.number(start, turn * NUMBERS + 1, size - 1)
        return prompt[:at] + prompt[at + 1] + prompt[at] + prompt[at + 2 :]

    def of_prompt(self, prompt: str | None, start: int, choices: dict[str, list[str]]) -> list:
        """The prompt, then its variants."""
        done = [prompt]
        if prompt is None:
            return done
        words = prompt.split()  # at the characters of ``text.SPACE``
        for turn in range(len(self.steps) // NUMBERS):
            if len(done) > self.count:
                break
            slot, text = self.slots[self.number(start, turn * NUMBERS, len(self.slots))], prompt
            if slot == "wrap":
                text = self.prefixes[self.number(start, turn * NUMBERS + 1, len(self.prefixes))] + prompt
            elif slot == "strip":
                text = stripped(prompt)
            elif slot == "typo":
                text = self.swap_letters(prompt, start, turn)
            elif len(words) >= 3:
                text = self.swap(prompt, words, choices, start, turn)
            if text not in done:
                done.append(text)
        return done


# What a worker makes of the variants of some prompts: a value for each text of an array of lists.
Results = Callable[[pa.Array], pa.Array]


def _made(
    prompts: DataFrame,
    synonyms: DataFrame,
    outs: dict[str, tuple[T.DataType, Results | None]],
    count: int = fv.MUTATION_COUNT,
    floor: float = fv.SIMILARITY_FLOOR,
    seed: int = 42,
    draw_key: str = "prompt_id",
    beside: dict[str, Column] | None = None,
) -> DataFrame:
    """Add an array for each of ``outs``: a value per variant of the prompt, or, without a function, the variants.

    Variants are made in the worker that needs them, so only what a plan uses comes back. An array of no use later
    is never computed. ``beside`` are other Python calls that get the prompt: they run in the same worker.
    """
    drawn_by = F.coalesce(F.col(draw_key).cast("string"), F.lit(""))
    frame, table = _with_choices(prompts.withColumn("start_", seed_of(drawn_by, seed)), synonyms)
    inputs = ["prompt", "start_"] + (["choices_"] if table is None else [])
    frame = frame.withColumn("start_", tx.pinned(F.col("start_")))
    maker = VariantMaker(fv.MUTATION_SLOTS, fv.WRAP_PREFIXES, stream(STREAMS), count, floor)

    def made(results: Results | None) -> Callable[..., pa.Array]:
        @portable
        def make(*columns: pa.Array) -> pa.Array:
            found, offsets = [], [np.zeros(1, np.int64)]
            texts, held = [], 0

            def put() -> None:
                lists = pa.array(texts, pa.list_(pa.string()))
                offsets.append(offsets[-1][-1] + np.cumsum(lists.value_lengths().to_numpy(zero_copy_only=False)))
                found.append(lists.flatten() if results is None else results(lists))

            for at in range(0, len(columns[0]), PROMPTS_PER_STEP):
                rows = [column.slice(at, PROMPTS_PER_STEP).to_pylist() for column in columns]
                choices = [dict(pairs or ()) for pairs in rows[2]] if table is None else repeat(table)
                for prompt, start, known in zip(*rows[:2], choices):
                    texts.append(maker.of_prompt(prompt, start, known))
                    held += len(texts[-1]) * len(prompt or "")
                    if held > CHARS_PER_STEP:
                        put()
                        texts, held = [], 0
            if texts:
                put()
            empty = pa.array([], pa.string() if results is None else pa.float64())
            return pa.ListArray.from_arrays(pa.array(np.concatenate(offsets), pa.int32()), pa.concat_arrays([empty, *found]))

        return make

    own = ("start_", "choices_", "words_")
    if all(results for _, results in outs.values()):
        columns = {name: arrow_udf(T.ArrayType(kind))(made(results))(*inputs) for name, (kind, results) in outs.items()}
        # In one projection, so that a worker gets the prompts once.
        frame = frame.withColumns(columns | (beside or {}))
        return frame.withColumns({name: tx.pinned(F.col(name)) for name in columns | (beside or {})}).drop(*own)
    # Texts come back in batches of their own size: those of all variants of a batch of prompts are too many at a time.
    frame = frame.withColumns(beside) if beside else frame
    kept = [name for name in frame.columns if name not in own]
    schema = T.StructType([T.StructField(name, frame.schema[name].dataType) for name in kept])
    for name, (kind, _) in outs.items():
        schema.add(name, T.ArrayType(kind))
    makers, names = [made(results) for _, results in outs.values()], [*kept, *outs]

    @portable
    def batches_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = pc.binary_length(batch.column("prompt")).fill_null(0).to_numpy(zero_copy_only=False)
            parts = np.cumsum(sizes, dtype=np.int64) // BYTES_PER_BATCH
            cuts = [0, *(np.flatnonzero(np.diff(parts)) + 1).tolist(), len(sizes)]
            for first, last in zip(cuts, cuts[1:]):
                part = batch.slice(first, last - first)
                values = [make(*[part.column(name) for name in inputs]) for make in makers]
                yield pa.RecordBatch.from_arrays([*(part.column(name) for name in kept), *values], names)

    return frame.mapInArrow(batches_of, schema)


def add_variants(prompts: DataFrame, synonyms: DataFrame, **options) -> DataFrame:
    """Add variants: the prompt itself, then up to ``count`` distinct variants of it.

    Fifteen turns each draw one of five slots. Wrapping and intent stripping are always
    admitted, synonyms and typos only from a similarity of ``floor``. A typo's similarity is
    known in closed form; a synonym swap's lies between two bounds, and only where they do not
    decide is the exact value computed. An empty prompt is only wrapped. Draws depend on the column ``draw_key``;
    a null counts as ''.
    """
    return _made(prompts, synonyms, {"variants": (T.StringType(), None)}, **options)


def add_variant_risks(prompts: DataFrame, synonyms: DataFrame, scorer, out: str = "risks", **options) -> DataFrame:
    """Add an array of risks, one per variant, by a scorer that works where the texts are.

    One with ``text_margins`` scores variants in the worker that makes them; another one gets an array of texts.
    """
    if not hasattr(scorer, "text_margins"):
        varied = _made(prompts, synonyms, {"variants": (T.StringType(), None)}, **options)
        return scorer.add_risks(varied, "variants", out).drop("variants")
    found = _made(prompts, synonyms, {"margins_": (T.DoubleType(), margins_of(prompts, scorer))}, **options)
    return found.withColumn(out, F.transform("margins_", scorer.risk_of_margin)).drop("margins_")


def margins_of(frame: DataFrame, scorer) -> Results:
    margins = scorer.text_margins(frame)

    @portable
    def of_lists(lists: pa.Array) -> pa.Array:
        return margins(lists.flatten())

    return of_lists


# -- consensus --------------------------------------------------------------


def consensus(
    risks: Column, word_count: Column, threshold: float = fv.CONSENSUS_THRESHOLD
) -> Column:
    """struct(layer_score, is_safe, mutation_count, max_risk) of the risks of all variants.

    0.7 of the worst plus 0.3 of the mean of the riskier half, halved for prompts of fewer than
    three words. Safety is tested before rounding.
    """
    half = F.greatest(F.lit(1), F.floor(F.size(risks) / 2).cast("int"))
    top = F.slice(F.sort_array(risks, asc=False), 1, half)
    mean = F.aggregate(top, F.lit(0.0), lambda total, risk: total + risk) / half
    raw = (0.7 * F.array_max(risks) + 0.3 * mean) * F.when(word_count < 3, 0.5).otherwise(1.0)
    return F.struct(
        F.round(raw, 4).alias("layer_score"),
        (raw < threshold).alias("is_safe"),
        F.size(risks).alias("mutation_count"),
        F.round(F.array_max(risks), 4).alias("max_risk"),
    )


def risk_counts(
    rows: DataFrame, key: str, risk: str = "risk", decimals: int | None = None
) -> DataFrame:
    """key, risk, n: equal risks of a key collapse before the shuffle.

    Risks count as they are. Rounded to ``decimals`` on demand, a key with very many rows stays small:
    at four decimals it has at most 10,001 different risks.
    """
    value = F.col(risk) if decimals is None else F.round(risk, decimals)
    return rows.groupBy(key, value.alias("risk")).agg(F.count("*").alias("n"))


def counted_consensus(
    pairs: Column, word_count: Column, threshold: float = fv.CONSENSUS_THRESHOLD
) -> Column:
    """The consensus of an array(risk, n) in which equal risks are counted."""
    total = F.aggregate(pairs, F.lit(0).cast("bigint"), lambda done, pair: done + pair["n"])

    def settle(half: Column) -> Column:
        summed = F.aggregate(
            F.sort_array(pairs, asc=False),
            F.struct(half.alias("left"), F.lit(0.0).alias("sum")),
            lambda done, pair: F.struct(
                F.greatest(F.lit(0).cast("bigint"), done["left"] - pair["n"]).alias("left"),
                (done["sum"] + pair["risk"] * F.least(done["left"], pair["n"])).alias("sum"),
            ),
        )
        worst = F.array_max(pairs)["risk"]
        raw = (0.7 * worst + 0.3 * summed["sum"] / half) * F.when(word_count < 3, 0.5).otherwise(1.0)
        return F.struct(
            F.round(raw, 4).alias("layer_score"),
            (raw < threshold).alias("is_safe"),
            total.cast("int").alias("mutation_count"),
            F.round(worst, 4).alias("max_risk"),
        )

    return tx.let(F.greatest(F.lit(1).cast("bigint"), F.floor(total / 2)), settle)


def ranked_consensus(counts: DataFrame, key: str) -> DataFrame:
    """key, raw: the same by rank, over counted risks; a window holds one key's different risks."""
    group = Window.partitionBy(key)
    before = F.sum("n").over(group.orderBy(F.desc("risk"))) - F.col("n")
    ranked = counts.withColumn("before", before).withColumn(
        "half", F.greatest(F.lit(1), F.floor(F.sum("n").over(group) / 2))
    )
    taken = F.least(F.col("n"), F.greatest(F.lit(0), F.col("half") - F.col("before")))
    return ranked.groupBy(key).agg(
        (0.7 * F.max("risk") + 0.3 * F.sum(taken * F.col("risk")) / F.max("half")).alias("raw")
    )


def variant_rows(frame: DataFrame, *columns: str) -> DataFrame:
    """prompt_id, pos, text and chosen columns: one row per variant, the prompt itself at 0."""
    return frame.select("prompt_id", *columns, F.posexplode_outer("variants").alias("pos", "text"))


def variant_similarity(prompts: DataFrame, synonyms: DataFrame, texts: bool = True, **options) -> DataFrame:
    """prompt_id, pos, text, n_words, semantic_sim: the embedding cosine of prompt and variant.

    Without ``texts`` they stay where they are made, and there is no such column.
    """
    outs = {"semantic_sim": (T.DoubleType(), em.text_cosines())}
    if texts:
        outs["text"] = (T.StringType(), None)
    varied = _made(prompts, synonyms, outs, **options).withColumn("n_words", tx.word_count(F.col("prompt")))
    zipped = F.arrays_zip(*[F.col(name) for name in outs])
    rows = varied.select("prompt_id", "n_words", F.posexplode_outer(zipped).alias("pos", "row"))
    return rows.select("prompt_id", "pos", *["row.text"] * texts, "n_words", "row.semantic_sim")


def mutation_report(
    prompts: DataFrame,
    synonyms: DataFrame,
    scorer,
    threshold: float = fv.CONSENSUS_THRESHOLD,
    texts: bool = True,
    **options,
) -> DataFrame:
    """prompt_id, layer_score, is_safe, details(mutation_count, max_risk, mutations_tested).

    Without ``texts`` those of the variants stay where they are scored, if the scorer can do that, and null stands for them.

    A scorer with ``add_risks`` scores the variants in their prompt's row and nothing is shuffled. Another one
    adds a risk to rows with a text, one row per variant; a group holds one prompt's variants.
    """
    if hasattr(scorer, "add_risks"):
        result = _tested_in_row(prompts, synonyms, scorer, texts, **options)
    else:
        result = _tested_as_rows(prompts, synonyms, scorer, **options)
    result = result.withColumn("c", consensus(F.col("risks"), F.col("n_words"), threshold))
    return result.select(
        "prompt_id",
        "c.layer_score",
        "c.is_safe",
        F.struct("c.mutation_count", "c.max_risk", F.col("tested").alias("mutations_tested")).alias("details"),
    )


def _tested(text: Column, risk: Column, semantic_sim: Column) -> Column:
    return F.struct(
        text.alias("text"), F.round(risk, 4).alias("risk"), F.round(semantic_sim, 2).alias("semantic_sim")
    )


def _tested_in_row(prompts: DataFrame, synonyms: DataFrame, scorer, texts: bool, **options) -> DataFrame:
    """prompt_id, n_words, risks, tested of every prompt, by a scorer that works on arrays."""
    outs = {"cosines_": (T.DoubleType(), em.text_cosines())}
    if hasattr(scorer, "text_margins"):
        outs["margins_"] = (T.DoubleType(), margins_of(prompts, scorer))
    if texts or "margins_" not in outs:
        outs["variants"] = (T.StringType(), None)
    varied = _made(prompts, synonyms, outs, **options).withColumn("n_words", tx.word_count(F.col("prompt")))
    if "margins_" in outs:
        scored = varied.withColumn("risks", F.transform("margins_", scorer.risk_of_margin))
    else:
        scored = scorer.add_risks(varied, "variants", "risks")
    # Zipped, not looked up by place: no Python call moves into a lambda.
    text = F.col("variants") if "variants" in outs else F.transform("risks", lambda _: F.lit(None).cast("string"))
    rows = F.arrays_zip(text.alias("text"), F.col("risks").alias("risk"), F.col("cosines_").alias("sim"))
    return scored.select(
        "prompt_id",
        "n_words",
        "risks",
        F.transform(rows, lambda row: _tested(row["text"], row["risk"], row["sim"])).alias("tested"),
    )


def _tested_as_rows(prompts: DataFrame, synonyms: DataFrame, scorer, **options) -> DataFrame:
    """prompt_id, n_words, risks, tested of every prompt, by a scorer that takes rows."""
    rows = variant_similarity(prompts, synonyms, **options)
    row = F.struct("pos", _tested(F.col("text"), F.col("risk"), F.col("semantic_sim")).alias("tested"))
    grouped = scorer(rows, "text").groupBy("prompt_id", "n_words").agg(
        F.collect_list("risk").alias("risks"), F.array_sort(F.collect_list(row)).alias("rows")
    )
    return grouped.select("prompt_id", "n_words", "risks", F.col("rows.tested").alias("tested"))
