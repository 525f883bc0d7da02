"""Blending of the four detectors, decisions, and the two user-level jobs.

Everything that needs the text (lexicon matches, similarity, variants, their scoring by an expression,
previews, the rewrite of at most fifty words) is computed in the row: with a scorer that works on arrays
and dictionaries of measured small size nothing is shuffled, and a stream can append what it scores. Texts
move in three cases: a scorer that takes rows gets the variants as rows (which it scores before they are
grouped by request), a lexicon too large for the row is joined, and a model that rewrites gets the texts of
the middle band.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sluicegate import fixed_values as fv
from sluicegate.functions import text as tx
from sluicegate.operators import lexicon as lx
from sluicegate.operators import nearest as nn
from sluicegate.operators.joins import localized
from sluicegate.operators.mutation import (
    add_variant_risks,
    add_variants,
    consensus,
    default_synonyms,
    variant_rows,
)
from sluicegate.operators.sanitize import HARM_LIMIT, TOPIC_TEXT, sanitize
from sluicegate.session import dimension, stored

LAYERS = tuple(fv.LAYER_WEIGHTS)
WEIGHTS_TYPE = "struct<" + ",".join(f"{name}:double" for name in LAYERS) + ">"


def profanity_terms() -> list[str]:
    return [term for term, _, category in lx.lexicon_rows() if category == "hate"]


def rule_sanitizer(text: Column) -> Column:
    return sanitize(text, profanity_terms())


@dataclass
class Detectors:
    """What the four detectors use. Only the scorer and the signatures have no default.

    scorer: adds a risk to rows with a text. signatures: sig_id, text, or sig_id, features of a stored
    index. lexicon: term, weight.
    lemmas: form, lemma. synonyms: word, synset_id, lemma.
    """

    scorer: Callable[[DataFrame, str], DataFrame]
    signatures: DataFrame
    lexicon: DataFrame | None = None
    lemmas: DataFrame | None = None
    synonyms: DataFrame | None = None
    mutation_options: dict = field(default_factory=dict)
    similarity_options: dict = field(default_factory=dict)

    def completed(self) -> Detectors:
        spark = self.signatures.sparkSession
        return Detectors(
            self.scorer,
            self.signatures,
            self.lexicon if self.lexicon is not None else lx.default_lexicon(spark),
            self.lemmas if self.lemmas is not None else lx.default_lemmas(spark),
            self.synonyms if self.synonyms is not None else default_synonyms(spark),
            self.mutation_options,
            self.similarity_options,
        )

    def loaded(self) -> Detectors:
        """The same for jobs that use it again and again: signatures are encoded and stored once, and
        small tables read once."""
        used = self.completed()
        encoder = used.similarity_options.get("encoder")
        encoded = stored(nn.encode_signatures(used.signatures, encoder), "encoded-signatures")
        tables = {name: localized(getattr(used, name)) for name in ("lexicon", "lemmas", "synonyms")}
        return replace(used, signatures=localized(encoded), **tables)


# -- blending and decisions -------------------------------------------------


def effective_weights(weights: Column | None = None) -> Column:
    """Weights with the default for every missing field. They are neither scaled nor checked."""
    if weights is None:
        return F.struct(*[F.lit(w).alias(name) for name, w in fv.LAYER_WEIGHTS.items()])
    return F.struct(
        *[F.coalesce(weights[name], F.lit(w)).alias(name) for name, w in fv.LAYER_WEIGHTS.items()]
    )


def weight_sum_off(weights: Column) -> Column:
    """Whether the weights, as whole percents, miss 100 by more than one."""
    percents = [F.round(weights[name] * 100).cast("int") for name in LAYERS]
    return F.abs(sum(percents[1:], percents[0]) - 100) > 1


def layer_scores(scores: dict[str, Column], weights: Column) -> Column:
    """array(name, score, weight, weighted_score) in layer order; each layer rounds on its own."""
    return F.array(
        *[
            F.struct(
                F.lit(name).alias("name"),
                F.round(scores[name], 4).alias("score"),
                weights[name].alias("weight"),
                F.round(scores[name] * weights[name], 4).alias("weighted_score"),
            )
            for name in LAYERS
        ]
    )


def weighted_sum(layers: Column) -> Column:
    """Sum of the rounded contributions, in layer order; no grouping involved."""
    return F.aggregate(
        layers, F.lit(0.0), lambda total, layer: total + layer["weighted_score"]
    )


def decide(score: Column) -> Column:
    return (
        F.when(score < fv.THRESHOLD_PASS, "pass")
        .when(score < fv.THRESHOLD_SANITIZE, "sanitize")
        .otherwise("block")
    )


def layer_band(score: Column) -> Column:
    return (
        F.when(score >= fv.THRESHOLD_SANITIZE, "high")
        .when(score >= fv.THRESHOLD_PASS, "medium")
        .otherwise("none")
    )


def config_table(spark: SparkSession) -> DataFrame:
    """section, key, value, text: weights, thresholds and what each action means."""
    rows = [("weights", name, weight, "") for name, weight in fv.LAYER_WEIGHTS.items()]
    rows += [
        ("thresholds", "pass", fv.THRESHOLD_PASS, ""),
        ("thresholds", "sanitize", fv.THRESHOLD_SANITIZE, ""),
    ]
    rows += [("actions", rule, None, text) for rule, text in fv.ACTION_TEXTS.values()]
    return dimension(spark, rows, "section string, key string, value double, text string")


# -- prompts ----------------------------------------------------------------


def validate(prompts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Prompts with at least one character, and the rejected rest."""
    good = F.coalesce(F.length("prompt") >= 1, F.lit(False))
    return prompts.filter(good), prompts.filter(~good)


def rejected(prompts: DataFrame) -> DataFrame:
    """The prompts that are not scored, with the reason."""
    return validate(prompts)[1].withColumn("reason", F.lit("a prompt needs at least one character"))


def requests(prompts: DataFrame, keyed: bool = True) -> DataFrame:
    """request, prompt_id, prompt, weights of the valid prompts.

    ``request`` is a hash of all that a request holds, for jobs that bring its parts together. Two texts
    under one id are two requests, a null id is an id like others, and only equal requests, whose
    results are equal, share the key. Unless ``keyed`` it is null.
    """
    valid, _ = validate(prompts)
    given = [F.col("weights")] if "weights" in prompts.columns else []
    content = F.to_json(F.struct("prompt_id", "prompt", *given))
    return valid.select(
        (F.sha2(content.cast("binary"), 256) if keyed else F.lit(None).cast("string")).alias("request"),
        "prompt_id",
        "prompt",
        effective_weights(given[0] if given else None).alias("weights"),
    )


def _grouped_risks(varied: DataFrame, detectors: Detectors) -> DataFrame:
    """request, slim, risks by a scorer that takes rows: a row per request, as often as it came."""
    # The original alone carries the slim columns; it is always the first variant.
    rows = variant_rows(varied, "slim").withColumn("slim", F.when(F.col("pos") == 0, F.col("slim")))
    most = detectors.mutation_options.get("count", fv.MUTATION_COUNT)
    at = [F.max(F.when(F.col("pos") == i, F.col("risk"))) for i in range(most + 1)]
    return (
        detectors.scorer(rows, "text")
        .groupBy("prompt_id")
        .agg(
            F.first("slim", ignorenulls=True).alias("slim"),
            F.array_compact(F.array(*at)).alias("risks"),
            F.count(F.when(F.col("pos") == 0, 1)).cast("int").alias("copies"),
        )
        .withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies"))))
        .drop("copy", "copies")
    )


def score_prompts(
    prompts: DataFrame,
    detectors: Detectors,
    sanitizer: Callable[[Column], Column] | None = None,
    keyed: bool = False,
) -> DataFrame:
    """request, prompt_id, prompt_preview, rewritten, layer_scores: the slim result of all detectors.

    A scorer with ``add_risks`` scores the variants where they are; another one gets them as rows,
    and their risks are put together by request. ``request`` is null if nothing needs it, ``rewritten`` may be null
    outside the middle band.
    """
    used = detectors.completed()
    text = F.col("prompt")
    in_row = hasattr(used.scorer, "add_risks")
    look_up = lx.row_lookup(used.lexicon, used.lemmas)
    moved = keyed or not in_row or look_up is None
    # The operators below group and draw by prompt_id; here that is the request.
    frame = requests(prompts, moved).select(
        F.col("request").alias("prompt_id"), F.col("prompt_id").alias("given_id"), "prompt", "weights"
    )
    given = dict(used.similarity_options)
    few = nn.few_buckets(used.signatures, given.pop("encoder", None), given.pop("broadcast", None))
    beside = {}
    if look_up and few is not None and in_row:
        # One worker gets the prompt, once, for all that looks at it.
        prompt = F.col("prompt")
        beside = {"matches": look_up.column(prompt), "distances_": nn.text_distances(few)(prompt)}
        looked_up = frame
    else:
        matched = look_up(frame, "prompt") if look_up else lx.add_matches(frame, used.lexicon, used.lemmas, in_row=False)
        matched = matched.withColumn("lexicon_score", lx.score_of(F.col("matches"))).drop("matches")
        looked_up = nn.add_similarity(matched, used.signatures, **used.similarity_options).drop("similarity_details")
    options = {**used.mutation_options, "draw_key": "given_id"}
    rewritten = sanitizer(text) if sanitizer else F.lit(None).cast("string")
    slim = F.struct(
        "given_id",
        tx.preview(text).alias("prompt_preview"),
        "weights",
        "lexicon_score",
        "similarity_score",
        # The consensus asks for fewer than three.
        F.size(tx.first_words(text, 3)).alias("n_words"),
        # In the row the text is there until the end, and the middle band alone is rewritten.
        *([] if in_row else [rewritten.alias("rewritten")]),
    )
    if in_row:
        scored = add_variant_risks(looked_up, used.synonyms, used.scorer, "risks", beside=beside, **options)
        if beside:
            scored = scored.withColumn("lexicon_score", lx.score_of(F.col("matches"))).withColumn(
                "similarity_score", nn.score_of_distances(F.col("distances_"), **given)
            )
        scored = scored.withColumn("slim", slim)
    else:
        varied = add_variants(looked_up, used.synonyms, **options).withColumn("slim", slim)
        scored = _grouped_risks(varied, used)
    scores = {
        "regex_analyzer": F.col("slim.lexicon_score"),
        "security_model": F.get("risks", F.lit(0)),
        "mutation_layer": consensus(F.col("risks"), F.col("slim.n_words"))["layer_score"],
        "bottleneck_extractor": F.col("slim.similarity_score"),
    }
    scored = scored.withColumn("layer_scores", tx.pinned(layer_scores(scores, F.col("slim.weights"))))
    if in_row:
        middle = decide(weighted_sum(F.col("layer_scores"))) == "sanitize"
        last = tx.pinned(F.when(middle, rewritten))
    else:
        last = F.col("slim.rewritten")
    return scored.select(
        F.col("prompt_id").alias("request"),
        F.col("slim.given_id").alias("prompt_id"),
        "slim.prompt_preview",
        last.alias("rewritten"),
        "layer_scores",
    )


def analyze(prompts: DataFrame, detectors: Detectors) -> DataFrame:
    """prompt_id, prompt_preview, action, weighted_score, layer_scores; nothing is rewritten."""
    scored = score_prompts(prompts, detectors).withColumn("sum_", weighted_sum(F.col("layer_scores")))
    return scored.select(
        "prompt_id",
        "prompt_preview",
        decide(F.col("sum_")).alias("action"),
        F.round("sum_", 4).alias("weighted_score"),
        "layer_scores",
    )


def gateway(
    prompts: DataFrame,
    detectors: Detectors,
    sanitizer: Callable[[Column], Column] | None = rule_sanitizer,
    block_failures: bool = False,
    rewrite_rows: Callable[[DataFrame], DataFrame] | None = None,
) -> DataFrame:
    """analyze, plus sanitized_prompt for the middle band. ``rejected`` has the prompts left out.

    ``sanitizer`` is a column function, for rewriting by rules. ``rewrite_rows`` is for models: it
    gets rows (request, prompt) of the middle band alone, each text once, and adds ``rewritten``.
    Without either the middle band is blocked. A failed rewrite keeps the failure text, or is
    blocked if ``block_failures`` is set. Prompts the lexicon rates harmful get a fixed text.
    """
    scored = score_prompts(prompts, detectors, None if rewrite_rows else sanitizer, rewrite_rows is not None)
    scored = scored.withColumn("sum_", weighted_sum(F.col("layer_scores")))
    action = decide(F.col("sum_"))
    if rewrite_rows:
        scored = stored(scored.drop("rewritten"), "scored")  # decided once, before any rewriting
        middle = scored.filter(action == "sanitize").select("request").distinct()
        texts = requests(prompts).select("request", "prompt").join(middle, "request", "left_semi")
        rewritten_rows = rewrite_rows(texts.dropDuplicates(["request"])).select("request", "rewritten")
        scored = scored.join(rewritten_rows, "request", "left")
    rewritten = F.coalesce("rewritten", F.lit(fv.SANITIZER_FAILURE_TEXT))
    harm = F.get("layer_scores", F.lit(0))["score"] >= HARM_LIMIT
    rewritten = F.when(
        harm & ~rewritten.isin(fv.SANITIZER_GENERIC_TEXT, fv.SANITIZER_FAILURE_TEXT), F.lit(TOPIC_TEXT)
    ).otherwise(rewritten)
    if sanitizer is None and rewrite_rows is None:
        blocked = action == "sanitize"
    elif block_failures:
        blocked = (action == "sanitize") & (rewritten == fv.SANITIZER_FAILURE_TEXT)
    else:
        blocked = F.lit(False)
    final = F.when(blocked, F.lit("block")).otherwise(action)
    return scored.select(
        "prompt_id",
        "prompt_preview",
        final.alias("action"),
        F.round("sum_", 4).alias("weighted_score"),
        "layer_scores",
        F.when(final == "sanitize", rewritten).alias("sanitized_prompt"),
    )
