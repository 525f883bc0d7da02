"""The four detectors and the jobs that combine them."""

from __future__ import annotations

import json

import numpy as np
from pyspark.sql import functions as F

from sluicegate import fixed_values as fv
from sluicegate.catalog import sql
from sluicegate.catalog import tables as tb
from sluicegate.catalog.registry import query
from sluicegate.catalog.text_queries import sql_rewrite
from sluicegate.functions import embedding as em
from sluicegate.functions import text as tx
from sluicegate.functions.portable import portable
from sluicegate.operators import classifier as cl
from sluicegate.operators import epochs as ep
from sluicegate.operators import lexicon as lx
from sluicegate.operators import mutation as mu
from sluicegate.operators import nearest as nn
from sluicegate.operators.sanitize import HARM_LIMIT, TOPIC_TEXT
from sluicegate.plans import dataset as ds
from sluicegate.plans import gateway as gw
from sluicegate.session import stored, work_dir
from sluicegate.sources import files
from sluicegate.streaming import gateway as stream

# -- lexicon ----------------------------------------------------------------


def _matches(spark, folder):
    return lx.lexicon_matches(tb.prompts(spark, folder), tb.lexicon(spark), tb.lemmas(spark))


@query("lexicon_exact", f"WITH {sql.MATCHES} SELECT prompt_id, term, weight FROM exact")
def lexicon_exact(spark, folder):
    found = lx.lexicon_matches(
        tb.prompts(spark, folder), tb.lexicon(spark), tb.lemmas(spark), fuzzy=False
    )
    return found.select("prompt_id", "term", "weight")


@query(
    "lexicon_fuzzy",
    f"WITH {sql.MATCHES} SELECT prompt_id, term, token, round(ratio, 4) AS ratio FROM fuzzy",
)
def lexicon_fuzzy(spark, folder):
    return (
        _matches(spark, folder)
        .filter(~F.col("is_exact"))
        .select("prompt_id", "term", "token", F.round("ratio", 4).alias("ratio"))
    )


@query(
    "lexicon_fuzzy_map",
    f"""WITH {sql.MATCHES}
SELECT DISTINCT token, term, round(ratio, 4) AS ratio FROM (
  SELECT token, term, ratio FROM near WHERE ratio >= 85
  UNION ALL SELECT token, term, 100.0::DOUBLE FROM vocabulary JOIN lexicon ON token = term)""",
)
def lexicon_fuzzy_map(spark, folder):
    """The map of the documents' words, stored, then grown by the words of the conversations that it hasn't seen."""
    tokens = lx.prompt_tokens(tb.prompts(spark, folder), tb.lemmas(spark), distinct=True)
    # Stored: both maps read the different words, and each prompt is normalised once.
    is_older = F.coalesce(F.col("prompt_id").like("d:%"), F.lit(False))
    words = stored(tokens.groupBy("token").agg(F.max(is_older).alias("is_older")), "vocabulary")
    known = stored(lx.fuzzy_map(words.filter("is_older"), tb.lexicon(spark)), "fuzzy-map")
    grown = lx.fuzzy_map(words, tb.lexicon(spark), known=known)
    return grown.filter("term is not null").select("token", "term", F.round("ratio", 4).alias("ratio"))


@query(
    "lexicon_score",
    f"WITH {sql.LEXICON_SCORES} SELECT prompt_id, round(lexicon_score, 4) AS lexicon_score FROM lexicon_scores",
)
def lexicon_score(spark, folder):
    scores = lx.lexicon_score(tb.prompts(spark, folder), tb.lexicon(spark), tb.lemmas(spark))
    return scores.select("prompt_id", F.round("lexicon_score", 4).alias("lexicon_score"))


@query("lexicon_triggers", f"WITH {sql.LEXICON_SCORES} SELECT prompt_id, triggers FROM lexicon_scores")
def lexicon_triggers(spark, folder):
    scores = lx.lexicon_score(tb.prompts(spark, folder), tb.lexicon(spark), tb.lemmas(spark))
    return scores.select("prompt_id", F.array_join("triggers", "|").alias("triggers"))


def _counted(spark, folder, lexicon):
    """Each entry with the number of prompts that hold it exactly."""
    found = lx.lexicon_matches(tb.prompts(spark, folder), lexicon, tb.lemmas(spark), fuzzy=False)
    counts = found.groupBy("term").agg(F.count("*").alias("n_prompts"))
    return lexicon.join(counts, "term", "left").withColumn(
        "n_prompts", F.coalesce("n_prompts", F.lit(0))
    )


_COUNTS = "(SELECT term, count(*) AS n_prompts FROM exact GROUP BY term) c USING (term)"


@query(
    "lexicon_merge",
    f"WITH {sql.MATCHES} SELECT term, weight, category, coalesce(n_prompts, 0) AS n_prompts "
    f"FROM lexicon LEFT JOIN {_COUNTS}",
)
def lexicon_merge(spark, folder):
    return _counted(spark, folder, tb.lexicon(spark))


@query(
    "lexicon_load",
    f"WITH {sql.MATCHES}, loaded(term, weight) AS {sql.values(list(tb.USER_LEXICON))} "
    f"SELECT term, loaded.weight, coalesce(n_prompts, 0) AS n_prompts FROM loaded LEFT JOIN {_COUNTS}",
)
def lexicon_load(spark, folder):
    path = work_dir(spark, "lexicon")
    text = json.dumps(dict(tb.USER_LEXICON))
    spark.createDataFrame([(text,)], "value string").write.text(path)
    return _counted(spark, folder, files.read_lexicon_json(spark, path))


_BAND = (
    f"CASE WHEN lexicon_score > {fv.REVIEW_HIGH} THEN 'high' WHEN lexicon_score > {fv.REVIEW_MODERATE} "
    "THEN 'moderate' ELSE 'safe' END"
)


@query(
    "review_bands",
    f"""WITH {sql.LEXICON_SCORES}, banded AS (
  SELECT coalesce(d.lang, 'turn') AS lang, {_BAND} AS band, lexicon_score
  FROM lexicon_scores s LEFT JOIN documents d ON s.prompt_id = 'd:' || d.doc_id)
SELECT lang, band, count(*) AS n, round(max(lexicon_score), 4) AS top FROM banded GROUP BY lang, band""",
)
def review_bands(spark, folder):
    scores = lx.lexicon_score(tb.prompts(spark, folder), tb.lexicon(spark), tb.lemmas(spark))
    langs = tb.table(spark, folder, "documents").select(
        F.concat(F.lit("d:"), F.col("doc_id").cast("string")).alias("prompt_id"), "lang"
    )
    return (
        scores.join(langs, "prompt_id", "left")
        .withColumn("band", lx.review_band(F.col("lexicon_score")))
        .groupBy(F.coalesce("lang", F.lit("turn")).alias("lang"), "band")
        .agg(F.count("*").alias("n"), F.round(F.max("lexicon_score"), 4).alias("top"))
    )


@query("text_files_scan", f"""WITH {sql.LEXICON_SCORES.replace(sql.PROMPTS, "prompts AS (SELECT item_id::VARCHAR AS prompt_id, text AS prompt FROM benchmark)")}
SELECT prompt_id, length(prompt)::INTEGER AS chars, {_BAND} AS band
FROM prompts JOIN lexicon_scores USING (prompt_id)""")
def text_files_scan(spark, folder):
    """Every benchmark text as a file of its own, read back whole and rated for review."""
    path = work_dir(spark, "texts")
    named = F.concat(F.col("item_id").cast("string"), F.lit("\n"), F.col("text"))
    items = tb.table(spark, folder, "benchmark").select(
        F.pmod(F.xxhash64("item_id"), F.lit(64)).alias("part"), named.alias("value")
    )
    items.write.partitionBy("part").option("maxRecordsPerFile", 1).option("lineSep", "\n").text(path)
    scanned = files.read_text_files(spark, path).select(
        F.substring_index("prompt", "\n", 1).alias("prompt_id"),
        F.regexp_replace(F.regexp_replace("prompt", r"\A[^\n]*\n", ""), r"\n\z", "").alias("prompt"),
    )
    scores = lx.lexicon_score(scanned, tb.lexicon(spark), tb.lemmas(spark))
    sizes = scanned.select("prompt_id", F.length("prompt").alias("chars"))
    return sizes.join(scores, "prompt_id").select(
        "prompt_id", "chars", lx.review_band(F.col("lexicon_score")).alias("band")
    )


# -- similarity -------------------------------------------------------------


@query(
    "knn_whole",
    f"""WITH pairs AS (
  SELECT q.vec_id, s.vec_id::VARCHAR AS sig_id,
         round(1 - list_cosine_similarity(q.embedding::DOUBLE[], s.embedding::DOUBLE[]), 12) AS distance
  FROM embeddings q, embeddings s WHERE s.label = 0)
SELECT vec_id, arg_min(sig_id, struct_pack(d := distance, s := sig_id)) AS sig_id,
       round(min(distance), 4) AS distance, min(distance) < {fv.WHOLE_PROMPT_DISTANCE} AS counts
FROM pairs GROUP BY vec_id""",
)
def knn_whole(spark, folder):
    """Every vector's nearest among the vectors labelled 0, which stand for known attacks."""
    vectors = tb.spread(tb.table(spark, folder, "embeddings"))
    known = vectors.filter("label = 0").select(
        F.col("vec_id").alias("sig_id"), F.col("embedding").alias("features")
    )
    found = nn.with_nearest(
        vectors.select("vec_id", F.array("embedding").alias("queries")),
        "queries", known, kind="dense", dimensions=64, key="vec_id",
    )
    hit = F.get("nearest", F.lit(0))
    return found.select(
        "vec_id",
        hit["sig_id"].alias("sig_id"),
        F.round(hit["distance"], 4).alias("distance"),
        (hit["distance"] < fv.WHOLE_PROMPT_DISTANCE).alias("counts"),
    )


_NEAREST = f"{sql.PROMPTS}, {sql.NEAREST}"


@query(
    "knn_sentence",
    f"WITH {_NEAREST} SELECT prompt_id, pos::INTEGER AS pos, sig_id, round(distance, 4) AS distance "
    f"FROM nearest WHERE distance < {fv.SENTENCE_DISTANCE} AND pos > 0",
)
def knn_sentence(spark, folder):
    known = tb.signatures(spark, folder).select(
        "sig_id", em.word_buckets(F.col("text")).alias("features")
    )
    bags = tb.prompts(spark, folder).select(
        "prompt_id", F.transform(
            tx.sentence_chunks(F.col("prompt")), lambda piece: em.word_buckets(piece)
        ).alias("bags")
    )
    found = nn.with_nearest(bags, "bags", known)
    hits = found.select("prompt_id", F.posexplode_outer("nearest").alias("pos", "hit"))
    return hits.filter(F.col("hit.distance") < fv.SENTENCE_DISTANCE).select(
        "prompt_id", (F.col("pos") + 1).alias("pos"), "hit.sig_id", F.round("hit.distance", 4).alias("distance")
    )


def _similar(spark, folder):
    return nn.add_similarity(tb.prompts(spark, folder), tb.signatures(spark, folder))


@query(
    "similarity_score",
    f"WITH {_NEAREST} SELECT prompt_id, round(similarity_score, 4) AS similarity_score, "
    "n_details::INTEGER AS n_details FROM similarities",
)
def similarity_score(spark, folder):
    return _similar(spark, folder).select(
        "prompt_id",
        F.round("similarity_score", 4).alias("similarity_score"),
        F.size("similarity_details").alias("n_details"),
    )


_INDEXED = _NEAREST.replace("item_id::VARCHAR AS sig_id", "sig_id").replace("FROM benchmark)", "FROM indexed)")


@query(
    "signature_index_search",
    f"""WITH indexed AS (SELECT text, 'id_' || (row_number() OVER (ORDER BY sha256(text)) - 1) AS sig_id
  FROM (SELECT DISTINCT text FROM benchmark)), {_INDEXED}
SELECT s.prompt_id, round(similarity_score, 4) AS similarity_score, n_details::INTEGER AS n_details,
  n.sig_id, round(n.distance, 4) AS distance FROM similarities s LEFT JOIN nearest n ON n.prompt_id = s.prompt_id AND n.pos = 0""",
)
def signature_index_search(spark, folder):
    """Every prompt against a store that was built in two steps: its score and nearest entry."""
    corpus = tb.table(spark, folder, "benchmark").select("text").distinct()
    index = ds.signature_index(corpus).select("sig_id", "features")
    store = nn.SignatureStore(spark, work_dir(spark, "signatures"))
    later = F.crc32("sig_id") % 4 == 0
    store.write(index.filter(~later), rows_per_part=16)
    store.write(index.filter(later), append=True, rows_per_part=16)
    scored = nn.add_similarity(tb.prompts(spark, folder), store)
    bags = em.WordBuckets().encode(scored.withColumn("texts", tx.pinned(F.array("prompt"))), "texts", "bags")
    hit = F.get("nearest", F.lit(0))
    return store.with_nearest(bags.drop("texts"), "bags").select(
        "prompt_id",
        F.round("similarity_score", 4).alias("similarity_score"),
        F.size("similarity_details").alias("n_details"),
        hit["sig_id"].alias("sig_id"),
        F.round(hit["distance"], 4).alias("distance"),
    )


@portable
def letter_counts(texts):
    """An encoder that isn't the default: how often each letter stands in a text."""
    return np.array([[text.count(chr(97 + i)) for i in range(26)] for text in texts], dtype=float)


_LETTER_BAG = "list_transform(list_filter(string_split(text, ''), lambda c: c >= 'a' AND c <= 'z'), lambda c: ascii(c) - 97)"


@query(
    "similarity_encoder",
    f"WITH {_NEAREST.replace(sql.bag('text'), _LETTER_BAG)} SELECT prompt_id, round(similarity_score, 4) AS similarity_score, "
    "n_details::INTEGER AS n_details FROM similarities",
)
def similarity_encoder(spark, folder):
    """The similarity layer with an encoder of the caller's, which makes vectors batch by batch."""
    encoder = em.BatchEncoder(letter_counts, 26)
    found = nn.add_similarity(tb.prompts(spark, folder), tb.signatures(spark, folder), encoder=encoder)
    return found.select(
        "prompt_id",
        F.round("similarity_score", 4).alias("similarity_score"),
        F.size("similarity_details").alias("n_details"),
    )


# Other limits than the published ones: a prompt counts below 0.8, a sentence below 0.5.
_LIMITS = (0.8, 0.5)


@query(
    "similarity_limits",
    f"WITH {_NEAREST} ".replace(
        f"CASE WHEN pos = 0 THEN {fv.WHOLE_PROMPT_DISTANCE} ELSE {fv.SENTENCE_DISTANCE} END",
        f"CASE WHEN pos = 0 THEN {_LIMITS[0]} ELSE {_LIMITS[1]} END",
    )
    + "SELECT prompt_id, round(similarity_score, 4) AS similarity_score, n_details::INTEGER AS n_details FROM similarities",
)
def similarity_limits(spark, folder):
    found = nn.add_similarity(
        tb.prompts(spark, folder), tb.signatures(spark, folder), whole_limit=_LIMITS[0], sentence_limit=_LIMITS[1]
    )
    return found.select(
        "prompt_id",
        F.round("similarity_score", 4).alias("similarity_score"),
        F.size("similarity_details").alias("n_details"),
    )


@query(
    "similarity_details",
    f"""WITH {_NEAREST} SELECT prompt_id, (row_number() OVER (PARTITION BY prompt_id ORDER BY pos) - 1)::INTEGER AS rank,
  CASE WHEN pos = 0 THEN 'ENTIRE PROMPT' ELSE text END AS text, round(distance, 4) AS distance,
  round(1 - distance, 4) AS score FROM counted""",
)
def similarity_details(spark, folder):
    details = _similar(spark, folder).select(
        "prompt_id", F.posexplode_outer("similarity_details").alias("rank", "detail")
    )
    return details.filter("rank is not null").select(
        "prompt_id",
        "rank",
        "detail.text",
        F.round("detail.distance", 4).alias("distance"),
        F.round("detail.score", 4).alias("score"),
    )


# -- classifier and mutation with a given linear model ----------------------


def _scorer():
    return cl.LinearScorer(tb.COEFFICIENTS, tb.INTERCEPT)


_TEXTS = "texts AS (SELECT prompt_id, prompt AS text FROM prompts)"
_RISKS = f"{sql.PROMPTS}, {_TEXTS}, {sql.risks('texts', 'prompt_id')}"


@query(
    "classifier_analyze",
    f"""WITH {_RISKS} SELECT prompt_id,
  CASE WHEN length(text) > {fv.SHORT_PREVIEW_CHARS} THEN substr(text, 1, {fv.SHORT_PREVIEW_CHARS}) || '...' ELSE text END AS text_preview,
  CASE WHEN risk > 0.5 THEN 'jailbreak/malicious' ELSE 'benign' END AS label,
  round(greatest(risk, 1 - risk), 4) AS confidence, risk > 0.5 AS is_dangerous FROM risks""",
)
def classifier_analyze(spark, folder):
    return cl.analyze_classifier(tb.prompts(spark, folder), _scorer()).select(
        "prompt_id",
        "text_preview",
        "prediction.label",
        F.round("prediction.confidence", 4).alias("confidence"),
        "prediction.is_dangerous",
    )


@query(
    "attributions",
    f"""WITH {_RISKS},
parts AS (SELECT prompt_id, word, weight * count(*) AS part
  FROM occurrences JOIN coefficients USING (word) JOIN risks USING (prompt_id)
  WHERE risk > 0.5 GROUP BY prompt_id, word, weight),
shares AS (SELECT prompt_id, word, part / sqrt(sum(part * part) OVER (PARTITION BY prompt_id)) AS impact FROM parts)
SELECT prompt_id, word, round(impact, 3) AS impact FROM shares WHERE impact >= {fv.ATTRIBUTION_FLOOR}""",
)
def attributions(spark, folder):
    analyzed = cl.analyze_classifier(tb.prompts(spark, folder), _scorer())
    return analyzed.select("prompt_id", F.explode_outer("bottleneck_features").alias("f")).filter(
        "f is not null"
    ).select("prompt_id", "f.word", "f.impact")


_VARIANT_RISKS = f"{sql.VARIANTS}, {sql.risks('variants', 'prompt_id, pos')}"
_COUNTED_RISKS = f"counted_risks AS (SELECT r.*, len({sql.words('prompt')}) AS words FROM risks r JOIN prompts USING (prompt_id))"


@query(
    "mutation_report",
    f"""WITH {sql.PROMPTS}, {_VARIANT_RISKS}, {_COUNTED_RISKS},
{sql.consensus('counted_risks', 'prompt_id', 'words')}
SELECT prompt_id, round(raw, 4) AS layer_score, raw < {fv.CONSENSUS_THRESHOLD}::DOUBLE AS is_safe,
  n::INTEGER AS mutation_count, round(max_risk, 4) AS max_risk FROM consensus""",
)
def mutation_report(spark, folder):
    report = mu.mutation_report(tb.prompts(spark, folder), mu.default_synonyms(spark), _scorer(), texts=False)
    return report.select(
        "prompt_id", "layer_score", "is_safe", "details.mutation_count", "details.max_risk"
    )


@query(
    "mutation_details",
    f"WITH {sql.PROMPTS}, {_VARIANT_RISKS} "
    "SELECT prompt_id, pos::INTEGER AS pos, md5(text) AS text_md5, round(risk, 4) AS risk FROM risks",
)
def mutation_details(spark, folder):
    """Every variant of the report and its risk; mutation_similarity has the cosines to four decimals."""
    report = mu.mutation_report(tb.prompts(spark, folder), mu.default_synonyms(spark), _scorer())
    tested = report.select("prompt_id", F.posexplode_outer("details.mutations_tested").alias("pos", "t"))
    return tested.select("prompt_id", "pos", F.md5("t.text").alias("text_md5"), "t.risk")


# -- gateway ----------------------------------------------------------------


def _detectors(spark, folder, scorer=None):
    return gw.Detectors(
        scorer=scorer or _scorer(),
        signatures=tb.signatures(spark, folder),
        lexicon=tb.lexicon(spark),
        lemmas=tb.lemmas(spark),
    )


_W = fv.LAYER_WEIGHTS
_LAYERS = f"""{sql.LEXICON_SCORES}, {sql.NEAREST}, {_VARIANT_RISKS}, {_COUNTED_RISKS},
{sql.consensus('counted_risks', 'prompt_id', 'words')},
layers AS (
  SELECT p.prompt_id, p.prompt, lexicon_score AS s1, r.risk AS s2, round(c.raw, 4) AS s3, similarity_score AS s4
  FROM prompts p JOIN lexicon_scores USING (prompt_id) JOIN similarities USING (prompt_id)
  JOIN risks r ON r.prompt_id = p.prompt_id AND r.pos = 0 JOIN consensus c ON c.prompt_id = p.prompt_id),
sums AS (
  SELECT *, round(s1 * {_W['regex_analyzer']}::DOUBLE, 4) + round(s2 * {_W['security_model']}::DOUBLE, 4)
    + round(s3 * {_W['mutation_layer']}::DOUBLE, 4) + round(s4 * {_W['bottleneck_extractor']}::DOUBLE, 4) AS total
  FROM layers)"""
_PREVIEW = f"CASE WHEN length(prompt) > {fv.PREVIEW_CHARS} THEN substr(prompt, 1, {fv.PREVIEW_CHARS}) || '...' ELSE prompt END"


@query(
    "layer_scores",
    f"""WITH {_LAYERS}, named AS (
  SELECT prompt_id, unnest([{", ".join(sql.quote(n) for n in _W)}]) AS name, unnest([s1, s2, s3, s4]) AS score,
         unnest([{", ".join(f"{w}::DOUBLE" for w in _W.values())}]) AS weight FROM layers)
SELECT prompt_id, name, round(score, 4) AS score, weight, round(score * weight, 4) AS weighted_score FROM named""",
)
def layer_scores(spark, folder):
    analyzed = gw.analyze(tb.prompts(spark, folder), _detectors(spark, folder))
    return analyzed.select("prompt_id", F.inline_outer("layer_scores"))


@query(
    "analyze",
    f"WITH {_LAYERS} SELECT prompt_id, {_PREVIEW} AS prompt_preview, {sql.band('total')} AS action, "
    "round(total, 4) AS weighted_score FROM sums",
)
def analyze(spark, folder):
    return gw.analyze(tb.prompts(spark, folder), _detectors(spark, folder)).drop("layer_scores")


_GATEWAY = f"""WITH {_LAYERS}, rewritten AS (
  SELECT *, {sql_rewrite("prompt")} AS rewrite, {sql.band('total')} AS action FROM sums)
SELECT prompt_id, {_PREVIEW} AS prompt_preview, action, round(total, 4) AS weighted_score,
  CASE WHEN action <> 'sanitize' THEN NULL
       WHEN s1 >= {HARM_LIMIT} AND rewrite <> {sql.quote(fv.SANITIZER_GENERIC_TEXT)} THEN {sql.quote(TOPIC_TEXT)}
       ELSE rewrite END AS sanitized_prompt
FROM rewritten"""


@query("gateway", _GATEWAY)
def gateway(spark, folder):
    return gw.gateway(tb.prompts(spark, folder), _detectors(spark, folder)).drop("layer_scores")


@query(
    "gateway_no_sanitizer",
    f"WITH {_LAYERS} SELECT action, count(*) AS n FROM (SELECT replace({sql.band('total')}, 'sanitize', 'block') "
    "AS action FROM sums) GROUP BY action",
)
def gateway_no_sanitizer(spark, folder):
    result = gw.gateway(tb.prompts(spark, folder), _detectors(spark, folder), sanitizer=None)
    return result.groupBy("action").agg(F.count("*").alias("n"))


@query(
    "layer_bands",
    f"""WITH {_LAYERS}, named AS (
  SELECT unnest([{", ".join(sql.quote(n) for n in _W)}]) AS name, unnest([s1, s2, s3, s4]) AS score FROM layers)
SELECT name, CASE WHEN round(score, 4) >= {fv.THRESHOLD_SANITIZE} THEN 'high' WHEN round(score, 4) >= {fv.THRESHOLD_PASS} THEN 'medium' ELSE 'none' END AS band,
  count(*) AS n FROM named GROUP BY ALL""",
)
def layer_bands(spark, folder):
    analyzed = gw.analyze(tb.prompts(spark, folder), _detectors(spark, folder))
    layers = analyzed.select(F.inline_outer("layer_scores"))
    return layers.groupBy("name", gw.layer_band(F.col("score")).alias("band")).agg(F.count("*").alias("n"))


@query("stream_gateway", _GATEWAY)
def stream_gateway(spark, folder):
    """Documents and user turns arriving as files, scored by a stream that appends, then read back."""
    documents = stream.read_table_stream(
        spark, f"{folder}/documents.parquet", "doc_id bigint, text string, lang string"
    ).select(
        F.concat(F.lit("d:"), F.col("doc_id").cast("string")).alias("prompt_id"),
        F.col("text").alias("prompt"),
    )
    turns = (
        stream.read_table_stream(
            spark, f"{folder}/conversations.parquet", "conv_id bigint, turn bigint, role string, text string"
        )
        .filter("role = 'user'")
        .select(
            F.concat_ws(":", F.lit("c"), F.col("conv_id").cast("string"), F.col("turn").cast("string")).alias(
                "prompt_id"
            ),
            F.col("text").alias("prompt"),
        )
    )
    arriving = documents.unionByName(turns)
    detectors = _detectors(spark, folder).loaded()
    target = work_dir(spark, "scored")
    cores = spark.sparkContext.defaultParallelism
    running = stream.start_append_stream(
        arriving.repartition(2 * cores),  # a file of these tables is one task
        lambda rows: gw.gateway(rows, detectors).drop("layer_scores"),
        target,
        work_dir(spark, "progress"),
        available_now=True,
    )
    running.awaitTermination()
    return spark.read.parquet(target)


# -- learned models ---------------------------------------------------------


def _training_rows(spark, folder):
    from sluicegate.operators.ranking import stratified_split

    rows = stratified_split(tb.labelled(spark, folder), "doc_id", "label")
    return stored(rows.select("doc_id", "text", "label", "is_test"), "training")


@query("classifier_train")
def classifier_train(spark, folder):
    """Quality on the held-out fifth of a model fitted on the rest."""
    rows = _training_rows(spark, folder)
    scorer = cl.ModelScorer(cl.train(rows.filter("not is_test")))
    held_out = scorer(rows.filter("is_test"), "text")
    return cl.classification_metrics(
        held_out, F.col("label"), (F.col("risk") > 0.5).cast("int")
    ).select("n", *[F.round(m, 4).alias(m) for m in ("accuracy", "precision", "recall", "f1")])


@query("classifier_epochs")
def classifier_epochs(spark, folder):
    """Quality on the held-out fifth after every epoch, and which one was kept."""
    rows = _training_rows(spark, folder)
    _, history = ep.train_epochs(rows.filter("not is_test"), rows.filter("is_test"))
    names = ("accuracy", "precision", "recall", "f1")
    rows = [(row["epoch"], row["n"], *[round(row[c], 4) for c in names], row["kept"]) for row in history]
    kinds = ", ".join(f"{c} double" for c in names)
    return spark.createDataFrame(rows, f"epoch int, n long, {kinds}, kept boolean")


_BUCKETS = 4096


def _bucket_list(x):
    return (
        f"list_transform({sql.model_words(x)}, "
        f"lambda w: (('0x' || substr(md5(w), 1, 8))::BIGINT % {_BUCKETS})::INTEGER)"
    )


# shares: bucket, weight of the model that one pass over the labelled documents gives; hashed_risks: its scores
_SHARES = f"""labelled AS (SELECT toxic AS label, {_bucket_list("text")} AS ids FROM labels JOIN documents USING (doc_id)),
sizes AS (SELECT count(*) FILTER (WHERE label = 1) AS n1, count(*) FILTER (WHERE label = 0) AS n0 FROM labelled),
seen AS (SELECT label, unnest(list_distinct(ids)) AS bucket FROM labelled),
shares AS (
  SELECT bucket, round((count(*) FILTER (WHERE label = 1) / greatest(any_value(n1), 1)::DOUBLE
                        - count(*) FILTER (WHERE label = 0) / greatest(any_value(n0), 1)::DOUBLE) * 4.0::DOUBLE, 6) AS weight
  FROM seen, sizes GROUP BY bucket),
id_lists AS (SELECT prompt_id, {_bucket_list("prompt")} AS ids FROM prompts),
placed AS (SELECT prompt_id, len(ids) AS n, unnest(range(len(ids))) AS place, unnest(ids) AS bucket FROM id_lists),
hashed_sums AS (
  SELECT prompt_id, n, place, sum(round(coalesce(weight, 0) * 1e6)::BIGINT) OVER (
    PARTITION BY prompt_id ORDER BY place ROWS BETWEEN {fv.MODEL_TOKENS - 1} PRECEDING AND CURRENT ROW) AS millionths
  FROM placed LEFT JOIN shares USING (bucket)),
largest AS (
  SELECT prompt_id, max(millionths)::DOUBLE AS millionths FROM hashed_sums
  WHERE place >= least(n, {fv.MODEL_TOKENS}) - 1 GROUP BY prompt_id),
hashed_risks AS (
  SELECT prompt_id, 1.0 / (1.0 + exp(-(coalesce(millionths, 0) / 1e6 - 1.0))) AS risk
  FROM prompts LEFT JOIN largest USING (prompt_id))"""


def _share_model(spark, folder):
    return ep.fit_shares(tb.labelled(spark, folder).select("label", "text"), _BUCKETS)


@query(
    "classifier_shares",
    f"""WITH {_SHARES.split("id_lists AS")[0].rstrip().rstrip(",")}
SELECT bucket, weight FROM shares WHERE weight <> 0""",
)
def classifier_shares(spark, folder):
    """The weights of a model over hashed words that one pass over the labelled documents gives."""
    path = work_dir(spark, "shares")
    _share_model(spark, folder).save(spark, path)
    kept = spark.read.parquet(path).filter("bucket >= 0")
    return kept.select("bucket", (F.col("millionths") / F.lit(1e6)).alias("weight"))


@query(
    "classifier_hashed_score",
    f"WITH {sql.PROMPTS}, {_SHARES} SELECT prompt_id, round(risk, 4) AS risk, risk > 0.5 AS is_dangerous FROM hashed_risks",
)
def classifier_hashed_score(spark, folder):
    """Every prompt scored by that model over all windows of its words, saved and loaded again."""
    path = work_dir(spark, "shares")
    _share_model(spark, folder).save(spark, path)
    scored = cl.classify(tb.prompts(spark, folder), ep.HashedScorer.load(spark, path))
    return scored.select("prompt_id", F.round("risk", 4).alias("risk"), "prediction.is_dangerous")


@query("attributions_occlusion")
def attributions_occlusion(spark, folder):
    """Words that drove the verdicts of a scorer that has no weights to show: each left out and scored again."""
    scorer = _scorer()
    scored = cl.classify(tb.prompts(spark, folder), scorer)
    dangerous = stored(scored.filter("prediction.is_dangerous").select("prompt_id", "prompt"), "dangerous")
    found = cl.attributions(dangerous, lambda rows, text: scorer(rows, text))
    return found.select("prompt_id", F.posexplode_outer("features").alias("pos", "f")).filter("f is not null").select(
        "prompt_id", "pos", "f.word", "f.impact"
    )


@query("classifier_select")
def classifier_select(spark, folder):
    """F1 of class 1 for every regularisation tried, on held-out rows, and which one was kept."""
    regs = (0.001, 0.01, 0.1)
    search = cl.select_model(_training_rows(spark, folder).filter("not is_test"), regs)
    kept = search.bestModel.stages[-1].getRegParam()
    rows = [(reg, float(f1), reg == kept) for reg, f1 in zip(regs, search.validationMetrics)]
    return spark.createDataFrame(rows, "reg double, f1 double, kept boolean")


@query("classifier_score")
def classifier_score(spark, folder):
    """Every prompt scored by a trained model that was saved and loaded again."""
    path = work_dir(spark, "model")
    cl.save_model(cl.train(_training_rows(spark, folder)), path)
    scored = cl.classify(tb.prompts(spark, folder), cl.load_scorer(path))
    return scored.select("prompt_id", "prediction.*", F.round("risk", 4).alias("risk"))


@query("gateway_trained")
def gateway_trained(spark, folder):
    """Actions of the whole gateway with the trained classifier."""
    scorer = cl.ModelScorer(cl.train(_training_rows(spark, folder)))
    result = gw.gateway(tb.prompts(spark, folder), _detectors(spark, folder, scorer))
    return result.select("prompt_id", "action", "weighted_score", "sanitized_prompt")
