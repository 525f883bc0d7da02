"""Weighted lexicon: loading, merging, exact and fuzzy matching, scoring.

The lexicon is turned into a key table: every term under its own text, and the longer ones also
under their segments. If a token is close enough to a term to count as a match, at most ``edits``
characters were inserted or deleted, so at least one of ``edits + 1`` segments of the term stands
in the token unchanged and shifted by no more than ``edits`` places. Looking up segments therefore
finds every match, and only the few pairs it yields are compared in full.

A lexicon of measured small size is looked up in the row: the key table goes to the tasks, which
compare each different token once, and nothing is shuffled. A larger one is joined with the
*distinct* tokens of all prompts. Their matches are a table of their own, ``fuzzy_map``, that can
be stored and grown by the tokens it hasn't seen; the tokens of the prompts are joined with it.
"""

from __future__ import annotations

from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import arrow_udf

from sluicegate import fixed_values as fv
from sluicegate.functions import text as tx
from sluicegate.functions.portable import portable
from sluicegate.functions.similarity import common_length, indel_ratio
from sluicegate.operators.joins import dimension_join, is_small, localized
from sluicegate.session import dimension, stored

LEXICON_SCHEMA = "term string, weight double, category string"
# Rows of the key table, and base words, up to which tokens are looked up in the row.
ROW_KEYS = 200_000
ROW_LEMMAS = 200_000
# Base words up to which they are part of the plan.
PLAN_LEMMAS = 2000
# Texts that a worker has as Python strings at a time.
TEXTS_PER_STEP = 512
# Different tokens that a task remembers.
REMEMBERED = 500_000
MATCH = T.StructType(
    [
        T.StructField("term", T.StringType()),
        T.StructField("weight", T.DoubleType()),
        T.StructField("is_exact", T.BooleanType()),
        T.StructField("token", T.StringType()),
        T.StructField("ratio", T.DoubleType()),
    ]
)


def lexicon_rows() -> list[tuple[str, float, str]]:
    return list(fv.LEXICON)


def default_lexicon(spark: SparkSession) -> DataFrame:
    return dimension(spark, lexicon_rows(), LEXICON_SCHEMA)


def inflections(word: str) -> list[str]:
    """Regular English forms of a word."""
    vowels = "aeiou"
    if word.endswith("fe"):
        plural = word[:-2] + "ves"
    elif word.endswith(("s", "x", "z", "ch", "sh")):
        plural = word + "es"
    elif word.endswith("y") and word[-2] not in vowels:
        plural = word[:-1] + "ies"
    else:
        plural = word + "s"
    if word.endswith("e"):
        stem = word[:-1]
    elif (
        word[-1] not in vowels + "wxy"
        and word[-2] in vowels
        and word[-3] not in vowels
        and len(word) <= 4
    ):
        stem = word + word[-1]
    else:
        stem = word
    past = word[:-1] + "ied" if word.endswith("y") and word[-2] not in vowels else stem + "ed"
    return [plural, past, stem + "ing"]


# Three-letter terms whose forms are English words; the others are names and abbreviations.
SHORT_INFLECTED = ("gun", "rat", "fag")


def inflected_forms(terms: list[str]) -> list[tuple[str, str]]:
    """Form and base word for single-word terms; a form that is a term itself stays one."""
    known = set(terms)
    forms: dict[str, str] = {}
    for term in terms:
        if term.isascii() and term.isalpha() and (len(term) > 3 or term in SHORT_INFLECTED):
            for form in inflections(term):
                if form not in known:
                    forms.setdefault(form, term)
    return list(forms.items())


def default_lemmas(spark: SparkSession) -> DataFrame:
    """Base words for the forms of the default lexicon's terms."""
    return dimension(
        spark, inflected_forms([row[0] for row in lexicon_rows()]), "form string, lemma string"
    )


def merge_lexicons(base: DataFrame, user: DataFrame) -> DataFrame:
    """Union by term; where both have a term the user's weight wins."""
    mine = user.select("term", F.col("weight").alias("user_weight"))
    theirs = base.select("term", F.col("weight").alias("base_weight"), "category")
    return theirs.join(mine, "term", "full_outer").select(
        "term",
        F.coalesce("user_weight", "base_weight").alias("weight"),
        F.coalesce("category", F.lit("user")).alias("category"),
    )


def choose_lexicon(
    base: DataFrame, merge: DataFrame | None = None, replace: DataFrame | None = None
) -> DataFrame:
    """A replacement stands alone; otherwise the merge table is laid over the base."""
    if replace is not None:
        return replace
    return base if merge is None else merge_lexicons(base, merge)


# -- tokens -----------------------------------------------------------------


def prompt_tokens(
    prompts: DataFrame, lemmas: DataFrame | None = None, distinct: bool = False
) -> DataFrame:
    """One row per token: prompt_id, pos, token (its base word if the lemma table has one).

    ``distinct`` keeps the first of equal tokens of a prompt, before any of them leaves the row.
    """
    tokens = tx.tokens(F.col("prompt"))
    # Outer explodes throughout the package: the inner form makes the optimizer add a filter on the
    # array, pushed below everything, which computes the whole array a second time.
    rows = prompts.select(
        "prompt_id",
        F.posexplode_outer(F.array_distinct(tokens) if distinct else tokens).alias("pos", "form"),
    ).filter("form is not null")
    if lemmas is None:
        return rows.withColumnRenamed("form", "token")
    return dimension_join(rows, lemmas, "form", "left", F.col("prompt_id")).select(
        "prompt_id", "pos", F.coalesce("lemma", "form").alias("token")
    )


def _counts_by_prompt(prompts: DataFrame, lemmas: DataFrame | None) -> DataFrame:
    rows = prompt_tokens(prompts, lemmas)
    # Per prompt first: the second step then counts prompts without a distinct.
    per = rows.groupBy("token", "prompt_id").agg(F.count("*").alias("n"), F.min("pos").alias("pos"))
    return per.groupBy("token").agg(
        F.sum("n").alias("n"), F.count("prompt_id").alias("n_prompts"), F.min("pos").alias("first_pos")
    )


def _counts_in_row(prompts: DataFrame, bases: dict[str, str]) -> DataFrame:
    """For prompts whose ids differ: a row adds one to each of its different tokens."""
    table = F.create_map(*[F.lit(x) for pair in bases.items() for x in pair]) if bases else None

    def base(form: Column) -> Column:
        return form if table is None else F.when(form.isin(list(bases)), F.try_element_at(table, form)).otherwise(form)

    def marks(words: Column) -> Column:
        everywhere = F.transform(words, lambda w, i: F.struct(w.alias("token"), i.alias("pos")))
        once = F.transform(
            F.array_distinct(words), lambda w: F.struct(w.alias("token"), F.lit(None).cast("int").alias("pos"))
        )
        return F.concat(everywhere, once)

    words = F.transform(tx.tokens(F.col("prompt")), base)
    rows = prompts.select(
        F.col("prompt_id").isNotNull().cast("int").alias("named"), F.explode_outer(tx.let(words, marks)).alias("m")
    ).filter("m is not null")
    return rows.groupBy(F.col("m.token").alias("token")).agg(
        F.count("m.pos").alias("n"),
        F.sum(F.when(F.col("m.pos").isNull(), F.col("named")).otherwise(0)).alias("n_prompts"),
        F.min("m.pos").alias("first_pos"),
    )


def token_counts(prompts: DataFrame, lemmas: DataFrame | None = None) -> DataFrame:
    """token, n, n_prompts, first_pos: how often a token stands in all prompts, in how many different ones, where first.

    A prompt without an id isn't counted as one. Different tokens are found in the row and added up per task, so
    no text is shuffled, and ids only once, alone, to find repeated ones. Prompts whose id stands in several rows are grouped by token and id, and all
    prompts are if such ids, or the base words, are too many.
    """
    ids = prompts.filter("prompt_id is not null").groupBy("prompt_id").agg(F.count("*").alias("rows"))
    repeated = stored(ids.filter("rows > 1").select("prompt_id"), "repeated")
    if not is_small(repeated) or (lemmas is not None and not is_small(lemmas, PLAN_LEMMAS)):
        return _counts_by_prompt(prompts, lemmas)
    bases = {row["form"]: row["lemma"] for row in lemmas.select("form", "lemma").collect()} if lemmas is not None else {}
    if repeated.isEmpty():
        return _counts_in_row(prompts, bases)
    repeated = F.broadcast(repeated)
    single = _counts_in_row(prompts.join(repeated, "prompt_id", "left_anti"), bases)
    several = _counts_by_prompt(prompts.join(repeated, "prompt_id", "left_semi"), lemmas)
    return single.unionByName(several).groupBy("token").agg(
        F.sum("n").alias("n"), F.sum("n_prompts").alias("n_prompts"), F.min("first_pos").alias("first_pos")
    )


# -- matching ---------------------------------------------------------------


def _edits(size: Column, other: Column, ratio: Column) -> Column:
    """Most characters that may be inserted or deleted at a given ratio."""
    return F.floor((size + other) * (100 - ratio) / 100 + 1e-9).cast("int")


def _reach(size: Column, ratio: Column) -> Column:
    """Longest token that can still reach the ratio."""
    return F.floor(size * (200 - ratio) / ratio + 1e-9).cast("int")


def _key_size(ratio: int) -> int:
    """Least size the segments of a long term can have; it depends on the ratio alone."""
    sizes = range(fv.FUZZY_SHORT_CHARS + 1, 400)
    edits = [(size + size * (200 - ratio) // ratio) * (100 - ratio) // 100 for size in sizes]
    return max(1, min(size // (most + 1) for size, most in zip(sizes, edits)))


def lexicon_keys(lexicon: DataFrame, ratio: int = fv.FUZZY_LONG_RATIO) -> DataFrame:
    """key, place, size, term, weight, segment: what a token can be looked up by.

    Whole terms stand at place 0. A segment stands at every place, and for every size of token,
    at which the ratio is still possible. Segments differ in size; their first characters are the
    key, so that a token is looked up once per place.
    """
    size, limit = F.length("term"), F.lit(ratio)
    edits = _edits(size, _reach(size, limit), limit)
    base, extra = F.floor(size / (edits + 1)).cast("int"), size % (edits + 1)
    plain = edits + 1 - extra

    def segment(i: Column) -> Column:
        start = i * base + F.greatest(F.lit(0), i - plain) + 1
        return F.struct(
            start.alias("at"),
            F.substring("term", start, base + (i >= plain).cast("int")).alias("segment"),
        )

    whole = lexicon.select(
        F.concat(F.lit("="), "term").alias("key"), F.lit(0).alias("place"), size.alias("size"),
        "term", "weight", F.col("term").alias("segment"),
    )
    parts = (
        lexicon.filter((size > fv.FUZZY_SHORT_CHARS) & (edits > 0))
        .withColumn("edits", edits)
        .withColumn("part", F.explode_outer(F.transform(F.sequence(F.lit(0), F.col("edits")), segment)))
        .withColumn("size", F.explode_outer(F.sequence(size - F.col("edits"), size + F.col("edits"))))
        .withColumn("edits", _edits(size, F.col("size"), limit))
        .filter(F.abs(size - F.col("size")) <= F.col("edits"))
    )
    first = F.greatest(F.lit(1), F.col("part.at") - F.col("edits"))
    placed = parts.withColumn(
        "place", F.explode_outer(F.sequence(first, F.col("part.at") + F.col("edits")))
    )
    key = F.substring("part.segment", 1, _key_size(ratio)).alias("key")
    return whole.unionByName(placed.select(key, "place", "size", "term", "weight", "part.segment"))


@portable
class TokenLookup:
    """Matches of tokens with a lexicon's key table; every different token is looked up once."""

    def __init__(self, keys: list[tuple], lemmas: dict[str, str], token: Callable, size: int, ratio: int, most: int):
        self.token = token
        self.lemmas, self.size, self.ratio, self.most = lemmas, size, ratio, most
        self.terms: dict[str, float] = {}
        parts: dict[int, dict[int, dict[str, list]]] = {}
        for key, place, length, term, weight, segment in keys:
            if place == 0:
                self.terms[term] = max(weight, self.terms.get(term, weight))
            else:
                parts.setdefault(length, {}).setdefault(place - 1, {}).setdefault(key, []).append((segment, term, weight))
        # By a token's size: its places, and what may begin there.
        self.parts = {length: list(places.items()) for length, places in parts.items()}
        self.known: dict[str, tuple] = {}

    def matches(self, form: str) -> tuple:
        """term, weight, is_exact, token, ratio of all terms that a form matches."""
        token = self.lemmas.get(form, form)
        found = {}
        if token in self.terms:
            found[token] = (token, self.terms[token], True, token, 100.0)
        for place, begins in self.parts.get(len(token), ()):
            for segment, term, weight in begins.get(token[place : place + self.size], ()):
                if term != token and token.startswith(segment, place):
                    ratio = 200.0 * common_length(token, term) / (len(token) + len(term))
                    if ratio >= self.ratio:
                        found[term] = (term, max(weight, found.get(term, (0, weight))[1]), False, token, ratio)
        return tuple(found.values())

    def of_prompt(self, raws: list[str]) -> list[tuple]:
        """The matches of a prompt's words, one per term: exact, else the most similar, else the first."""
        known, best = self.known, {}
        if len(known) > self.most:
            known.clear()
        for raw in raws:
            found = known.get(raw)
            if found is None:
                found = known[raw] = self.matches(self.token(raw))
            for match in found:
                held = best.get(match[0])
                if held is None or (match[2], match[4]) > (held[2], held[4]):
                    best[match[0]] = match
        return [best[term] for term in sorted(best)]


def row_lookup(
    lexicon: DataFrame, lemmas: DataFrame | None = None, fuzzy: bool = True, ratio: int = fv.FUZZY_LONG_RATIO
) -> Callable[[DataFrame, str], DataFrame] | None:
    """A function that adds ``matches``, an array of (term, weight, is_exact, token, ratio), to rows with a text.

    Its ``column`` is the same as an expression. None if the lexicon or the base words are too many for it, by measure.
    """
    keys = lexicon_keys(localized(lexicon.select("term", "weight")), ratio)
    if not fuzzy:
        keys = keys.filter("place = 0")
    if not is_small(keys, ROW_KEYS) or (lemmas is not None and not is_small(lemmas, ROW_LEMMAS)):
        return None
    table = keys.select("key", "place", "size", "term", "weight", "segment").toArrow()  # bounded by the check
    rows = list(zip(*(column.to_pylist() for column in table.columns))) if len(table) else []
    bases = {}
    if lemmas is not None:
        found = lemmas.select("form", "lemma").toArrow()
        bases = dict(zip(found["form"].to_pylist(), found["lemma"].to_pylist()))
    shared = lexicon.sparkSession.sparkContext.broadcast((rows, bases, tx.token_folds()))
    size, most = _key_size(ratio), REMEMBERED
    made: list = []
    lookup, tokenizer = TokenLookup, tx.Tokenizer

    @arrow_udf(T.ArrayType(MATCH))
    @portable
    def look_up(texts: pa.Array) -> pa.Array:
        if not made:
            keys, lemmas, folds = shared.value
            words = tokenizer(folds)
            made.extend((words, lookup(keys, lemmas, words.token, size, ratio, most)))
        words, terms = made
        found = []
        for at in range(0, len(texts), TEXTS_PER_STEP):
            some = texts.slice(at, TEXTS_PER_STEP).to_pylist()
            found += [terms.of_prompt(words.raw(text)) if text else [] for text in some]
        flat = [match for matches in found for match in matches]
        offsets = [0]
        for matches in found:
            offsets.append(offsets[-1] + len(matches))
        kinds = (pa.string(), pa.float64(), pa.bool_(), pa.string(), pa.float64())
        columns = zip(*flat) if flat else [[]] * len(kinds)
        entries = pa.StructArray.from_arrays(
            [pa.array(column, kind) for column, kind in zip(columns, kinds)],
            names=["term", "weight", "is_exact", "token", "ratio"],
        )
        return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), entries)

    def add(frame: DataFrame, text: str) -> DataFrame:
        return frame.withColumn("matches", look_up(F.col(text)))

    add.column = look_up
    return add


def fuzzy_map(
    tokens: DataFrame, lexicon: DataFrame, ratio: int = fv.FUZZY_LONG_RATIO, known: DataFrame | None = None
) -> DataFrame:
    """token, term, weight, is_exact, ratio of different tokens; term is null where no term is like a token.

    ``known`` is a map of the same lexicon and ratio: its tokens are taken from it, the others looked up. So the
    work follows the tokens that no map has seen, however often they stand in prompts.
    """
    # Stored: keys and result read the different tokens, and what made them runs once.
    tokens = stored(tokens.select("token").distinct(), "vocabulary")
    if known is not None:
        new = fuzzy_map(tokens.join(known.select("token").distinct(), "token", "left_anti"), lexicon, ratio)
        return known.unionByName(new)
    lexicon = localized(lexicon.select("term", "weight"))
    size, whole = F.col("size"), F.concat(F.lit("="), "token")
    longest = lexicon.agg(F.max(F.length("term"))).first()[0] or 0
    reach = longest * (200 - ratio) // ratio
    least = -(-(fv.FUZZY_SHORT_CHARS + 1) * ratio // (200 - ratio))
    places = F.when(size.between(least, reach), size).otherwise(0)
    looked_up = (
        tokens.withColumn("size", F.length("token"))
        .withColumn("place", F.explode_outer(F.sequence(F.lit(0), places)))
        .withColumn(
            "key",
            F.when(F.col("place") == 0, whole).otherwise(F.substring("token", F.col("place"), F.lit(_key_size(ratio)))),
        )
    )
    pairs = dimension_join(looked_up, lexicon_keys(lexicon, ratio), ["key", "place", "size"], "inner", F.col("token"))
    is_exact = F.col("place") == 0
    near = (
        "substring(token, place, length(segment)) = segment"
        " and token <> term and levenshtein(token, term, edits) >= 0"
    )
    ratios = F.when(is_exact, F.lit(100.0)).otherwise(indel_ratio(F.col("token"), F.col("term")))
    found = (
        pairs.withColumn("edits", _edits(size, F.length("term"), F.lit(ratio)))
        .filter(f"place = 0 or ({near})")
        .withColumn("ratio", ratios)
        .filter(F.col("ratio") >= ratio)
        .groupBy("token", "term")
        .agg(F.max("weight").alias("weight"), F.max(is_exact).alias("is_exact"), F.max("ratio").alias("ratio"))
    )
    return tokens.join(found, "token", "left")


def _joined_matches(
    prompts: DataFrame, lexicon: DataFrame, lemmas: DataFrame | None, fuzzy: bool, ratio: int
) -> DataFrame:
    """The matches by way of the distinct tokens, for a lexicon of any size."""
    # Stored: the vocabulary and the join read the tokens, and no prompt is normalised for each of them.
    tokens = stored(prompt_tokens(prompts, lemmas, distinct=True), "tokens")
    found = fuzzy_map(tokens, lexicon, ratio).filter("term is not null")
    if not fuzzy:
        found = found.filter("is_exact")
    # Few words of a language are like a term: their table is mostly small, else salted against frequent words.
    pairs = dimension_join(tokens, found, "token", "inner", F.col("prompt_id"))
    return pairs.groupBy("prompt_id", "term").agg(
        F.max("weight").alias("weight"),
        F.max("is_exact").alias("is_exact"),
        F.max_by("token", F.struct("is_exact", "ratio", -F.col("pos"))).alias("token"),
        F.max("ratio").alias("ratio"),
    )


def lexicon_matches(
    prompts: DataFrame,
    lexicon: DataFrame,
    lemmas: DataFrame | None = None,
    fuzzy: bool = True,
    ratio: int = fv.FUZZY_LONG_RATIO,
    in_row: bool | None = None,
) -> DataFrame:
    """prompt_id, term, weight, is_exact, token, ratio: one row per term found in a prompt.

    A term found exactly is not looked for fuzzily; otherwise its best token counts, the first
    one on ties. Terms of up to four characters need a ratio of 95, which only equality reaches.
    """
    add = row_lookup(lexicon, lemmas, fuzzy, ratio) if in_row is not False else None
    if add is None:
        return _joined_matches(prompts, lexicon, lemmas, fuzzy, ratio)
    found = add(prompts.select("prompt_id", "prompt"), "prompt")
    return found.select("prompt_id", F.explode_outer("matches").alias("m")).filter("m is not null").select(
        "prompt_id", "m.*"
    )


def trigger(term: Column, token: Column, is_exact: Column) -> Column:
    return F.when(is_exact, term).otherwise(F.concat(term, F.lit(" (matched: '"), token, F.lit("')")))


def score_of(matches: Column) -> Column:
    """The sum of the weights of an array of matches, at most 1."""
    kind = "decimal(28,9)"
    total = F.aggregate(
        matches, F.lit(0).cast(kind), lambda sum_, m: (sum_ + m["weight"].cast("decimal(18,9)")).cast(kind)
    )
    return F.least(total.cast("double"), F.lit(1.0))


def triggers_of(matches: Column) -> Column:
    shown = F.transform(matches, lambda m: trigger(m["term"], m["token"], m["is_exact"]))
    return F.array_sort(F.array_distinct(shown))


def add_matches(
    prompts: DataFrame, lexicon: DataFrame, lemmas: DataFrame | None = None, in_row: bool | None = None
) -> DataFrame:
    """Add ``matches`` to prompts: in the row, or, for a large lexicon, by a join on prompt_id."""
    add = row_lookup(lexicon, lemmas) if in_row is not False else None
    if add is not None:
        return add(prompts, "prompt")
    found = lexicon_matches(prompts.select("prompt_id", "prompt"), lexicon, lemmas, in_row=False)
    names = [field.name for field in MATCH]
    grouped = found.groupBy("prompt_id").agg(F.array_sort(F.collect_list(F.struct(*names))).alias("matches"))
    # A group holds at most one row per term of the lexicon.
    return prompts.join(grouped, "prompt_id", "left").withColumn(
        "matches", F.coalesce("matches", F.array().cast(T.ArrayType(MATCH)))
    )


def lexicon_score(
    prompts: DataFrame, lexicon: DataFrame, lemmas: DataFrame | None = None, in_row: bool | None = None
) -> DataFrame:
    """prompt_id, lexicon_score, triggers for every prompt; 0 and none without a hit."""
    return add_matches(prompts.select("prompt_id", "prompt"), lexicon, lemmas, in_row).select(
        "prompt_id",
        score_of(F.col("matches")).alias("lexicon_score"),
        triggers_of(F.col("matches")).alias("triggers"),
    )


def review_band(score: Column) -> Column:
    """Bands for reviewing files on the lexicon score alone; limits belong to the lower band."""
    return (
        F.when(score > fv.REVIEW_HIGH, "high").when(score > fv.REVIEW_MODERATE, "moderate").otherwise("safe")
    )
