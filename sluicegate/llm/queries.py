"""The corpus operators as registered queries over the given tables."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sluicegate.catalog.tables import table
from sluicegate.functions.text import let
from sluicegate.llm import (
    alignment,
    bpe,
    decontamination,
    language,
    licenses,
    periodicity,
    pii,
    quality,
    secrets,
    simhash,
    tokens,
    toxicity,
    urls,
)
from sluicegate.llm.checks import CORPUS_CHECKS
from sluicegate.llm.common import documents, held_out
from sluicegate.session import stored

__all__ = ["CORPUS_CHECKS", "CORPUS_QUERIES"]

TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")
PIECE_TOKENIZER = public_tokenizers.path("piece_bpe_32k.model")
MODEL_TOKENS = 512


# A job passes its own; with another key every surrogate is another one.
SURROGATE_KEY = "corpus-surrogates"


def op1_surrogates(spark: SparkSession, folder: str) -> DataFrame:
    """doc_id, text with surrogates, n_mentions of every document."""
    docs = documents(spark, folder).select("doc_id", "text")
    return pii.replace(docs, SURROGATE_KEY, counts="n_mentions")


def op2_language(spark: SparkSession, folder: str) -> DataFrame:
    """doc_id, held_out, lang_pred, score, n_spans of every document."""
    docs = documents(spark, folder)
    model = language.fit(docs.filter(~held_out()))
    named = docs.select("doc_id", held_out().alias("held_out"), "text")
    return language.label(named, model, keep=["doc_id", "held_out"], with_spans=False)


def op3_token_counts(spark: SparkSession, folder: str) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit of every document."""
    counted = tokens.count_tokens(documents(spark, folder), TOKENIZER, keep=["doc_id"])
    return counted.withColumn("over_limit", F.col("n_tokens") > MODEL_TOKENS)


def op4_quality(spark: SparkSession, folder: str) -> DataFrame:
    """doc_id, the counts, base_failed and kept of every document."""
    judged = quality.judge(documents(spark, folder), keep=["doc_id"])
    return judged.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"
    )


def op5_url_verdicts(spark: SparkSession, folder: str) -> DataFrame:
    """page_id, host, path, rule, verdict of every page."""
    return urls.judge(table(spark, folder, "pages"), keep=["page_id"])


def op6_bpe(spark: SparkSession, folder: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of every document, encoded and decoded again."""
    return bpe.round_trip(documents(spark, folder), TOKENIZER, keep=["doc_id"])


def op7_simhash(spark: SparkSession, folder: str) -> DataFrame:
    """doc_id, fingerprint (hexadecimal), component_id of every document."""
    grouped = simhash.group_documents(documents(spark, folder))
    digits = F.lpad(F.lower(F.hex("fingerprint")), 16, "0")
    return grouped.select("doc_id", digits.alias("fingerprint"), "component_id")


def op8_decontamination(spark: SparkSession, folder: str) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated of every document."""
    found = decontamination.find_benchmark(
        documents(spark, folder), table(spark, folder, "benchmark"), keep=["doc_id"]
    )
    return found.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"),
        "contaminated",
    )


def op9_secrets(spark: SparkSession, folder: str) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans of every document."""
    found = secrets.find_secrets(documents(spark, folder), keep=["doc_id"])
    return found.select("doc_id", *[column.alias(name) for name, column in secrets.summary(found).items()])


def toxicity_model(spark: SparkSession, folder: str) -> toxicity.Model:
    """Learned from the labels of documents that aren't held out."""
    return toxicity.fit(documents(spark, folder), table(spark, folder, "labels").filter(~held_out()))


def op10_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    """doc_id, held_out, score, predicted of every document."""
    named = documents(spark, folder).select("doc_id", held_out().alias("held_out"), "text")
    scored = toxicity.score(named, toxicity_model(spark, folder), keep=["doc_id", "held_out"])
    return scored.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def with_planted_runs(doc_id: Column, text: Column) -> Column:
    """The text, in which a tenth of the documents gets a periodic end."""
    h = F.crc32(doc_id.cast("string").cast("binary"))
    g = F.floor(h / 10)

    def planted(words: Column) -> Column:
        n = F.size(words)
        a = (g % F.greatest(n, F.lit(1))).cast("int")
        p = (1 + F.floor((n - a) / (3 + g % 8))).cast("int")
        times = F.ceil((n - a) / p).cast("int")
        end = F.slice(F.flatten(F.array_repeat(F.slice(words, a + 1, p), times)), 1, n - a)
        return F.when(n > 0, F.array_join(F.concat(F.slice(words, 1, a), end), " ")).otherwise(text)

    words = F.array_remove(F.split(text, r"[\x20\x09-\x0D]+"), "")
    return F.when((h % 10 == 0) & text.isNotNull(), let(words, planted)).otherwise(text)


def op11_periodic_runs(spark: SparkSession, folder: str) -> DataFrame:
    """doc_id, n_runs, the strongest run and the digests of every document."""
    docs = documents(spark, folder).select("doc_id", with_planted_runs(F.col("doc_id"), F.col("text")).alias("text"))
    found = periodicity.find_runs(docs, keep=["doc_id"]).withColumn("best", periodicity.strongest(F.col("runs")))
    lines = F.transform("runs", lambda run: F.concat_ws(",", run["start"], run["length"], run["period"]))
    ended = F.concat(F.array_join(lines, "\n"), F.when(F.size("runs") > 0, "\n").otherwise(""))
    return found.select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        "best.start",
        "best.length",
        "best.period",
        F.expr("best.length * 1000 div best.period").alias("exponent_milli"),
        F.sha2(ended.cast("binary"), 256).alias("runs_sha256"),
        F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"),
    )


def op12_licenses(spark: SparkSession, folder: str) -> DataFrame:
    """doc_id, n_words, the base places, the labels and the score of every document."""
    found = licenses.scan(documents(spark, folder), keep=["doc_id"])
    base = F.filter("notices", lambda notice: notice["kind"] == "base")

    def labels(notices: Column) -> Column:
        return F.array_join(F.array_sort(F.array_distinct(F.transform(notices, lambda n: n["label"]))), ",")

    return found.select(
        "doc_id",
        "n_words",
        F.size(base).cast("long").alias("n_base"),
        F.array_min(F.transform(base, lambda notice: notice["word"])).alias("first_word"),
        F.array_max(F.transform(base, lambda notice: notice["word"])).alias("last_word"),
        labels(base).alias("base_labels"),
        labels(F.col("notices")).alias("labels"),
        "score",
    )


def op13_alignment(spark: SparkSession, folder: str) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256 of every document."""
    aligned = alignment.align(documents(spark, folder), TOKENIZER, PIECE_TOKENIZER, keep=["doc_id"])
    digest = F.when(F.col("n_a") > 0, F.sha2(F.col("groups").cast("binary"), 256)).otherwise("")
    kept = stored(aligned.withColumn("groups_sha256", digest).drop("groups"), "alignments")
    counted = alignment.add_counts(kept, alignment.vocabulary_size(TOKENIZER))
    names = ("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")
    return counted.select(*names)


CORPUS_QUERIES = {
    "op1_surrogates": op1_surrogates,
    "op2_language": op2_language,
    "op3_token_counts": op3_token_counts,
    "op4_quality": op4_quality,
    "op5_url_verdicts": op5_url_verdicts,
    "op6_bpe": op6_bpe,
    "op7_simhash": op7_simhash,
    "op8_decontamination": op8_decontamination,
    "op9_secrets": op9_secrets,
    "op10_toxicity": op10_toxicity,
    "op11_periodic_runs": op11_periodic_runs,
    "op12_licenses": op12_licenses,
    "op13_alignment": op13_alignment,
}
