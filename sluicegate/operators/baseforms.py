"""Base words of a vocabulary: ranked suffix rules, longest suffix first, and a table of exceptions.

A form's base is what the exceptions say, else the first rewriting that gives a known word. So a rule never invents
a word: ``king`` isn't ``k``, and ``shooting`` is ``shoot`` only where ``shoot`` is known. The work follows the
different words of a corpus, not their places: candidates are made once per form, joined with the known words, and
the one of the best rank stays.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sluicegate import fixed_values as fv
from sluicegate.operators.joins import dimension_join
from sluicegate.session import dimension

LEAST_STEM = 2


def rules() -> list[tuple[str, str, bool]]:
    """Suffix, what replaces it, and whether a doubled letter before it becomes a single one, by rank."""
    ranked = sorted(enumerate(fv.SUFFIX_RULES), key=lambda item: (-len(item[1][0]), item[0]))
    return [rule for _, rule in ranked]


def candidates(form: Column) -> Column:
    """Array of (rank, base) that the rules make of a form."""
    made = []
    for rank, (suffix, new, doubled) in enumerate(rules()):
        fits = form.endswith(suffix) & (F.length(form) >= len(suffix) + LEAST_STEM)
        stem = F.left(form, F.length(form) - len(suffix))
        if doubled:
            # The last two letters of the stem are one consonant, twice.
            fits &= form.rlike(rf"([b-df-hj-np-tv-z])\1{suffix}$")
            stem = F.left(stem, F.length(stem) - 1)
        base = F.concat(stem, F.lit(new))
        made.append(F.when(fits, F.struct(F.lit(rank).alias("rank"), base.alias("base"))))
    return F.array_compact(F.array(*made))


def base_words(forms: DataFrame, known: DataFrame, exceptions: DataFrame | None = None) -> DataFrame:
    """form, lemma of the different forms (column ``form``) that have a base other than themselves.

    ``known`` has the words (column ``word``) that may be bases. A form that is one itself stays as it is, unless an
    exception names it. ``exceptions``: form, lemma; those of the package if none are given.
    """
    if exceptions is None:
        exceptions = dimension(forms.sparkSession, list(fv.IRREGULAR_FORMS), "form string, lemma string")
    different = forms.select("form").distinct()
    irregular = dimension_join(different, exceptions.select("form", "lemma").dropDuplicates(["form"]), "form", "inner")
    words = known.select(F.col("word").alias("base")).distinct()
    # Without an exception and no known word themselves.
    open_forms = different.join(exceptions.select("form"), "form", "left_anti").join(
        words.withColumnRenamed("base", "form"), "form", "left_anti"
    )
    made = open_forms.select("form", F.explode(candidates(F.col("form"))).alias("c")).select("form", "c.rank", "c.base")
    regular = (
        dimension_join(made, words, "base", "inner", F.col("form"))
        .groupBy("form")
        .agg(F.min_by("base", "rank").alias("lemma"))
    )
    return irregular.unionByName(regular).filter("form <> lemma")
