"""Sources, sinks, data-set jobs, weights, bands and consensus over given numbers."""

from __future__ import annotations

from pyspark.sql import functions as F

from sluicegate import fixed_values as fv
from sluicegate.catalog import sql
from sluicegate.catalog import tables as tb
from sluicegate.catalog.registry import query
from sluicegate.operators import classifier as cl
from sluicegate.operators import mutation as mu
from sluicegate.operators import ranking as rk
from sluicegate.plans import dataset as ds
from sluicegate.plans import gateway as gw
from sluicegate.session import work_dir
from sluicegate.sources import files
from sluicegate.streaming import gateway as stream

# -- sources and sinks ------------------------------------------------------


@query("csv_roundtrip", "SELECT doc_id, text, lang FROM documents")
def csv_roundtrip(spark, folder):
    path = work_dir(spark, "csv")
    files.write_csv(tb.spread(tb.table(spark, folder, "documents").select("doc_id", "text", "lang")), path)
    return files.read_csv(spark, path, "doc_id bigint, text string, lang string")


@query("jsonl_roundtrip", "SELECT conv_id, turn, role, text FROM conversations")
def jsonl_roundtrip(spark, folder):
    path = work_dir(spark, "json")
    tb.spread(tb.table(spark, folder, "conversations")).write.json(path)
    return files.read_json_lines(spark, path, "conv_id bigint, turn bigint, role string, text string")


@query(
    "guarded_source",
    "SELECT 'prompts' AS source, count(*) AS n FROM documents UNION ALL SELECT 'no column', 0 UNION ALL SELECT 'no file', 0",
)
def guarded_source(spark, folder):
    path = work_dir(spark, "guarded")
    files.write_csv(
        tb.spread(tb.table(spark, folder, "documents").select("doc_id", F.col("text").alias("Prompt"))), path
    )
    parts = {
        "prompts": files.read_guarded_csv(spark, path, "Prompt"),
        "no column": files.read_guarded_csv(spark, path, "Question"),
        "no file": files.read_guarded_csv(spark, path + "-missing", "Prompt"),
    }
    counted = [
        part.agg(F.count("*").alias("n")).select(F.lit(name).alias("source"), "n")
        for name, part in parts.items()
    ]
    return counted[0].unionByName(counted[1]).unionByName(counted[2])


# -- training set -----------------------------------------------------------

_LABELLED = "labelled AS (SELECT d.doc_id, text, lang, toxic AS label FROM documents d JOIN labels l ON d.doc_id = l.doc_id)"


def _write_sources(spark, folder) -> dict[str, str]:
    """The labelled documents as the four kinds of source file, one language each."""
    rows = tb.spread(tb.labelled(spark, folder))
    paths = {name: work_dir(spark, name) for name in ("synthetic", "benchmark", "cleaned", "evasion")}
    word = F.col("label").cast("int")

    def named(one: str, zero: str):
        return F.when(word == 1, one).otherwise(zero).alias("label")

    files.write_csv(
        rows.filter("lang = 'en'").select(
            F.concat("text", F.lit(". Example "), F.col("doc_id").cast("string"), F.lit(".")).alias("prompt_clean"),
            named("harmful", "safe"),
            F.col("lang").alias("topic"),
        ),
        paths["synthetic"],
    )
    files.write_csv(rows.filter("lang = 'fr'").select("text", named("jailbreak", "benign")), paths["benchmark"])
    files.write_csv(
        rows.filter("lang = 'de'").select(F.col("text").alias("Prompt"), word.alias("Value")), paths["cleaned"]
    )
    others = rows.filter("lang not in ('en', 'fr', 'de') or lang is null")
    others.select(F.col("text").alias("prompt"), named("malicious", "benign"), "lang").write.json(paths["evasion"])
    return paths


@query(
    "training_set",
    f"WITH {_LABELLED} SELECT CASE WHEN lang = 'en' THEN {sql.strip('text')} ELSE text END AS text, label FROM labelled",
)
def training_set(spark, folder):
    return ds.training_set(spark, _write_sources(spark, folder), work_dir(spark, "final"))


@query(
    "drop_embedded_headers",
    f"WITH {_LABELLED} SELECT label::VARCHAR AS label, count(*) AS n FROM labelled GROUP BY ALL",
)
def drop_embedded_headers(spark, folder):
    """Labels of a file to which two sets were appended with a header row inside each."""
    rows = tb.labelled(spark, folder).select("text", F.col("label").cast("string").alias("label"))
    headers = tb.table(spark, folder, "documents").groupBy("source").agg(F.count("*")).select(
        F.lit("text").alias("text"), F.lit("label").alias("label")
    )
    return ds.drop_embedded_headers(rows.unionByName(headers)).groupBy("label").agg(F.count("*").alias("n"))


_WORD = "CASE WHEN role = 'user' THEN 'jailbreak' WHEN role = 'assistant' THEN 'benign' ELSE role END"


@query(
    "label_encode",
    f"""SELECT conv_id, turn, CASE {_WORD} WHEN 'jailbreak' THEN 1 WHEN 'benign' THEN 0 END AS code,
  {_WORD} NOT IN ('jailbreak', 'benign') AS quarantined FROM conversations""",
)
def label_encode(spark, folder):
    """Roles as label words; those outside the vocabulary go to the quarantine branch."""
    rows = tb.table(spark, folder, "conversations").select("conv_id", "turn", F.expr(_WORD).alias("label"))
    good, bad = ds.split_labels(rows, "benchmark")
    return good.select("conv_id", "turn", F.col("label").alias("code"), F.lit(False).alias("quarantined")).unionByName(
        bad.select("conv_id", "turn", F.lit(None).cast("int").alias("code"), F.lit(True).alias("quarantined"))
    )


@query(
    "label_violations",
    "SELECT label::VARCHAR AS value, count(*) AS n FROM embeddings WHERE label NOT IN (0, 1) GROUP BY ALL",
)
def label_violations(spark, folder):
    return ds.label_violations(tb.table(spark, folder, "embeddings"))


@query("label_counts", f"WITH {_LABELLED} SELECT label, count(*) AS n FROM labelled GROUP BY label")
def label_counts(spark, folder):
    return ds.label_counts(tb.labelled(spark, folder))


@query("label_values", "SELECT DISTINCT label FROM embeddings")
def label_values(spark, folder):
    return tb.table(spark, folder, "embeddings").select("label").distinct()


@query(
    "table_profile",
    "WITH p AS (SELECT "
    + ", ".join(f"count({c}) AS {c}" for c in ("doc_id", "text", "lang", "source", "n_chars"))
    + ", count(*) AS n_rows FROM documents) "
    + " UNION ALL ".join(
        f"SELECT '{c}' AS column_name, '{t}' AS data_type, {c} AS non_null, n_rows FROM p"
        for c, t in (
            ("doc_id", "bigint"), ("text", "string"), ("lang", "string"), ("source", "string"), ("n_chars", "bigint"),
        )
    ),
)
def table_profile(spark, folder):
    return ds.table_profile(tb.table(spark, folder, "documents"))


@query(
    "written_profile",
    "WITH t AS (SELECT doc_id, text, label FROM (SELECT doc_id, text, toxic AS label FROM labels JOIN documents USING (doc_id)))"
    + " UNION ALL ".join(
        f" SELECT '{c}' AS column_name, '{t}' AS data_type, count(*) AS n_rows, count({c}) AS non_null, "
        f"{'min(label)::VARCHAR' if c == 'label' else 'NULL'} AS least, "
        f"{'max(label)::VARCHAR' if c == 'label' else 'NULL'} AS greatest FROM t"
        for c, t in (("doc_id", "bigint"), ("text", "string"), ("label", "int"))
    ),
)
def written_profile(spark, folder):
    """The profile of the labelled documents, taken while they are written."""
    rows = tb.labelled(spark, folder).select("doc_id", "text", F.col("label").cast("int").alias("label"))
    path = work_dir(spark, "profiled")
    return ds.written_profile(rows, lambda frame: frame.write.parquet(path), "label")


@query("table_head", "SELECT doc_id, lang, n_chars FROM documents ORDER BY n_chars DESC, doc_id LIMIT 5")
def table_head(spark, folder):
    return (
        tb.table(spark, folder, "documents")
        .select("doc_id", "lang", "n_chars")
        .orderBy(F.desc("n_chars"), "doc_id")
        .limit(5)
    )


@query(
    "class_weights",
    f"""WITH {_LABELLED}, c AS (SELECT label, count(*) AS n FROM labelled GROUP BY label)
SELECT label, n, round((SELECT sum(n) FROM c) / ((SELECT count(*) FROM c) * n), 6) AS weight FROM c""",
)
def class_weights(spark, folder):
    weights = cl.class_weights(tb.labelled(spark, folder))
    return weights.withColumn("weight", F.round("weight", 6))


_HASH = "('0x' || substr(md5('42:' || doc_id), 1, 8))::BIGINT"


@query(
    "stratified_split",
    f"""WITH {_LABELLED},
c AS (SELECT label, count(*) AS n, sum(count(*)) OVER () AS total FROM labelled GROUP BY label),
t AS (SELECT *, total - ceil(total * 0.2) AS train FROM c),
w AS (SELECT *, (train * n)::BIGINT // total::BIGINT AS whole, (train * n)::BIGINT % total::BIGINT AS rest FROM t),
q AS (SELECT label, n - whole - CASE WHEN row_number() OVER (ORDER BY rest DESC, label)
        <= train - sum(whole) OVER () THEN 1 ELSE 0 END AS test_rows FROM w),
r AS (SELECT doc_id, label, row_number() OVER (PARTITION BY label ORDER BY {_HASH}, doc_id) AS rank FROM labelled)
SELECT doc_id, label, rank <= test_rows AS is_test FROM r JOIN q USING (label)""",
)
def stratified_split(spark, folder):
    return rk.stratified_split(tb.labelled(spark, folder), "doc_id", "label").select("doc_id", "label", "is_test")


@query(
    "classification_metrics",
    """WITH j AS (SELECT toxic AS y, CASE WHEN quality = 0 THEN 1 ELSE 0 END AS p FROM labels),
c AS (SELECT count(*) AS n, count(*) FILTER (WHERE y = 1 AND p = 1) AS tp, count(*) FILTER (WHERE y = 0 AND p = 1) AS fp,
  count(*) FILTER (WHERE y = 1 AND p = 0) AS fn, count(*) FILTER (WHERE y = p) AS ok FROM j)
SELECT n, round(ok / n, 4) AS accuracy, round(tp / (tp + fp), 4) AS precision, round(tp / (tp + fn), 4) AS recall,
  round(2 * tp / (2 * tp + fp + fn), 4) AS f1 FROM c""",
)
def classification_metrics(spark, folder):
    """How well bad quality predicts toxicity."""
    rows = tb.table(spark, folder, "labels")
    metrics = cl.classification_metrics(rows, F.col("toxic"), (F.col("quality") == 0).cast("int"))
    return metrics.select("n", *[F.round(m, 4).alias(m) for m in ("accuracy", "precision", "recall", "f1")])


@query(
    "argmax_label",
    """SELECT event_id, CASE WHEN value - floor(value) > 1 - (value - floor(value)) THEN 'jailbreak/malicious' ELSE 'benign' END AS name
FROM events WHERE value IS NOT NULL""",
)
def argmax_label(spark, folder):
    """The larger of two scores made from each event's value, as a class name."""
    part = F.col("value") - F.floor("value")
    events = tb.table(spark, folder, "events").filter("value is not null")
    return events.select("event_id", cl.label_name(cl.argmax(F.array(1 - part, part))).alias("name"))


# -- signatures -------------------------------------------------------------

_CORPUS = """corpus AS (
  SELECT text FROM conversations WHERE role = 'user'
  UNION SELECT text FROM benchmark WHERE text IS NOT NULL
  UNION SELECT text FROM documents WHERE text IS NOT NULL)"""


def _corpus_parts(spark, folder):
    """User turns as the labelled split, benchmark and documents as the second list."""
    path = work_dir(spark, "splits")
    turns = tb.table(spark, folder, "conversations")
    turns.select(
        "text",
        F.when(F.col("role") == "user", "jailbreak").otherwise("benign").alias("label"),
        F.when(F.col("role") == "system", "train").otherwise("test").alias("split"),
    ).write.partitionBy("split").parquet(path)
    extra = tb.table(spark, folder, "benchmark").select("text").unionByName(
        tb.table(spark, folder, "documents").select("text")
    )
    return files.read_split(spark, path, "test"), extra


def _corpus(spark, folder):
    return ds.signature_corpus(*_corpus_parts(spark, folder))


@query("signature_corpus", f"WITH {_CORPUS} SELECT text FROM corpus")
def signature_corpus(spark, folder):
    return _corpus(spark, folder)


@query(
    "signature_corpus_stats",
    f"""WITH {_CORPUS} SELECT (SELECT count(*) FROM conversations WHERE role = 'user') AS labelled,
  (SELECT count(*) FROM benchmark) + (SELECT count(*) FROM documents) AS listed, (SELECT count(*) FROM corpus) AS distinct_texts""",
)
def signature_corpus_stats(spark, folder):
    """Counts of the corpus and of what went into it, taken while it is written."""
    path = work_dir(spark, "corpus")
    counts = ds.write_corpus(*_corpus_parts(spark, folder), lambda corpus: corpus.write.parquet(path))
    return spark.createDataFrame([tuple(counts.values())], "labelled long, listed long, distinct_texts long")


@query(
    "signature_ids",
    f"WITH {_CORPUS} SELECT 'id_' || (row_number() OVER (ORDER BY sha256(text)) - 1) AS sig_id, sha256(text) AS text_key FROM corpus",
)
def signature_ids(spark, folder):
    return rk.dense_ids(_corpus(spark, folder)).select("sig_id", "text_key")


@query(
    "signature_index_build",
    f"""WITH {_CORPUS}, k AS (SELECT text, 'id_' || (row_number() OVER (ORDER BY sha256(text)) - 1) AS sig_id FROM corpus),
b AS (SELECT sig_id, text, {sql.bag('text')} AS bag FROM k)
SELECT sig_id, md5(text) AS text_md5, len(bag)::INTEGER AS n, coalesce(list_sum(bag), 0)::BIGINT AS bucket_sum FROM b""",
)
def signature_index_build(spark, folder):
    """The stored index, read back."""
    path = work_dir(spark, "signatures")
    ds.write_signatures(ds.signature_index(_corpus(spark, folder)), path)
    index = spark.read.parquet(path)
    return index.select(
        "sig_id",
        F.md5("text").alias("text_md5"),
        F.size("features").alias("n"),
        F.aggregate("features", F.lit(0).cast("bigint"), lambda t, b: t + b).alias("bucket_sum"),
    )


# -- weights, blending and bands over given numbers -------------------------

# The lines of an order stand for variants of one prompt; -0.0 becomes 0.0.
_NUMBERS = {
    "regex_analyzer": "l_discount * 10 + 0.0D",
    "security_model": "l_tax * 12.5D + 0.0D",
    "mutation_layer": "l_quantity / 50",
    "bottleneck_extractor": "l_discount * 5 + 0.0D",
}
_SQL_NUMBERS = [
    "(l_discount * 10 + 0.0::DOUBLE)", "(l_tax * 12.5::DOUBLE + 0.0::DOUBLE)", "(l_quantity / 50)",
    "(l_discount * 5 + 0.0::DOUBLE)",
]
_SUM = " + ".join(
    f"round({x} * {w}::DOUBLE, 4)" for x, w in zip(_SQL_NUMBERS, fv.LAYER_WEIGHTS.values())
)


def _lines(spark, folder):
    rows = tb.spread(tb.table(spark, folder, "lineitem"))
    return rows.select(
        "l_orderkey", "l_linenumber", "l_returnflag", *[F.expr(x).alias(name) for name, x in _NUMBERS.items()]
    )


def _line_layers():
    return gw.layer_scores({name: F.col(name) for name in fv.LAYER_WEIGHTS}, gw.effective_weights())


@query("weighted_score", f"SELECT l_orderkey, l_linenumber, round({_SUM}, 4) AS weighted_score FROM lineitem")
def weighted_score(spark, folder):
    return _lines(spark, folder).select(
        "l_orderkey", "l_linenumber", F.round(gw.weighted_sum(_line_layers()), 4).alias("weighted_score")
    )


@query("decide_action", f"SELECT l_returnflag, {sql.band(_SUM)} AS action, count(*) AS n FROM lineitem GROUP BY ALL")
def decide_action(spark, folder):
    total = gw.weighted_sum(_line_layers())
    decided = _lines(spark, folder).select("l_returnflag", gw.decide(total).alias("action"))
    return decided.groupBy("l_returnflag", "action").agg(F.count("*").alias("n"))


@query(
    "config_table",
    f"""WITH a AS (SELECT {sql.band(_SUM)} AS action, count(*) AS n FROM lineitem GROUP BY ALL),
c(section, key, value, text, action) AS {sql.values(
    [("weights", n, w, "", "") for n, w in fv.LAYER_WEIGHTS.items()]
    + [("thresholds", "pass", fv.THRESHOLD_PASS, "", ""), ("thresholds", "sanitize", fv.THRESHOLD_SANITIZE, "", "")]
    + [("actions", rule, -1.0, text, action) for action, (rule, text) in fv.ACTION_TEXTS.items()]
)}
SELECT section, key, CASE WHEN section <> 'actions' THEN value END AS value, text, coalesce(n, 0) AS n
FROM c LEFT JOIN a USING (action)""",
)
def config_table(spark, folder):
    """The configuration, with the number of lines each action applies to."""
    counts = decide_action(spark, folder).groupBy("action").agg(F.sum("n").alias("n"))
    rule = F.create_map(*[F.lit(x) for action, (rule, _) in fv.ACTION_TEXTS.items() for x in (action, rule)])
    used = counts.select(F.try_element_at(rule, F.col("action")).alias("key"), "n")
    return gw.config_table(spark).join(used, "key", "left").withColumn("n", F.coalesce("n", F.lit(0)))


_GIVEN = {
    "regex_analyzer": "CASE WHEN l_returnflag <> 'N' THEN l_quantity / 100 END",
    "security_model": "CASE WHEN l_linenumber <= 2 THEN l_discount * 5 + 0.0 END",
    "mutation_layer": "CASE WHEN l_linestatus = 'O' THEN l_tax * 5 + 0.0 END",
    "bottleneck_extractor": "CASE WHEN l_returnflag = 'N' AND l_linenumber = 1 THEN 0.25 END",
}
_EFFECTIVE = {n: f"coalesce({x}, {fv.LAYER_WEIGHTS[n]})::DOUBLE" for n, x in _GIVEN.items()}


def _with_weights(spark, folder):
    rows = tb.spread(tb.table(spark, folder, "lineitem"))
    given = F.struct(*[F.expr(x).cast("double").alias(name) for name, x in _GIVEN.items()])
    return rows.select("l_orderkey", "l_linenumber", gw.effective_weights(given).alias("w"))


@query(
    "effective_weights",
    "SELECT l_orderkey, l_linenumber, "
    + ", ".join(f"round({x}, 6) AS {name}" for name, x in _EFFECTIVE.items())
    + " FROM lineitem",
)
def effective_weights(spark, folder):
    return _with_weights(spark, folder).select(
        "l_orderkey", "l_linenumber", *[F.round(f"w.{name}", 6).alias(name) for name in fv.LAYER_WEIGHTS]
    )


@query(
    "weight_sum_check",
    "SELECT l_orderkey, l_linenumber, abs("
    + " + ".join(f"round({x} * 100)::INTEGER" for x in _EFFECTIVE.values())
    + " - 100) > 1 AS off FROM lineitem",
)
def weight_sum_check(spark, folder):
    return _with_weights(spark, folder).select(
        "l_orderkey", "l_linenumber", gw.weight_sum_off(F.col("w")).alias("off")
    )


_RISK = "round(l_discount * 10, 4) + 0.0"


@query(
    "classifier_risk",
    """WITH r AS (SELECT l_orderkey, l_linenumber, round(l_discount * 10, 4) + 0.0 AS p FROM lineitem)
SELECT l_orderkey, l_linenumber, CASE WHEN p > 0.5 THEN 'jailbreak/malicious' ELSE 'benign' END AS label, round(p, 4) AS risk FROM r""",
)
def classifier_risk(spark, folder):
    rows = tb.table(spark, folder, "lineitem").withColumn("p", F.expr(_RISK))
    told = rows.withColumn("told", cl.prediction_of_risk(F.col("p")))
    return told.select(
        "l_orderkey", "l_linenumber", "told.label", F.round(cl.risk_of(F.col("told")), 4).alias("risk")
    )


_LINE_RISKS = f"line_risks AS (SELECT l_orderkey, ({_RISK})::DOUBLE AS risk FROM lineitem)"


def _line_risks(spark, folder):
    lines = tb.table(spark, folder, "lineitem")
    return lines.select("l_orderkey", F.expr(_RISK).cast("double").alias("risk"))


@query(
    "mutation_score",
    f"""WITH {_LINE_RISKS}, {sql.consensus('line_risks', 'l_orderkey')}
SELECT l_orderkey, round(raw, 4) AS layer_score, raw < {fv.CONSENSUS_THRESHOLD}::DOUBLE AS is_safe, n::INTEGER AS mutation_count,
  round(max_risk, 4) AS max_risk FROM consensus""",
)
def mutation_score(spark, folder):
    """Consensus over the lines of each order."""
    counts = mu.risk_counts(_line_risks(spark, folder), "l_orderkey")
    grouped = counts.groupBy("l_orderkey").agg(F.collect_list(F.struct("risk", "n")).alias("pairs"))
    return grouped.select(
        "l_orderkey", mu.counted_consensus(F.col("pairs"), F.lit(3)).alias("c")
    ).select("l_orderkey", "c.*")


@query(
    "mutation_score_window",
    f"""WITH {_LINE_RISKS}, {sql.consensus('line_risks', 'l_orderkey')}
SELECT l_orderkey, round(raw, 4) AS layer_score FROM consensus""",
)
def mutation_score_window(spark, folder):
    """The same, the riskier half taken by rank."""
    counts = mu.risk_counts(_line_risks(spark, folder), "l_orderkey")
    return mu.ranked_consensus(counts, "l_orderkey").select(
        "l_orderkey", F.round("raw", 4).alias("layer_score")
    )


@query(
    "stream_weighted",
    f"SELECT l_orderkey, l_linenumber, round({_SUM}, 4) AS weighted_score, {sql.band(_SUM)} AS action FROM lineitem",
)
def stream_weighted(spark, folder):
    """Blending as an append-mode stream, run until nothing is left, then read back."""
    schema = tb.table(spark, folder, "lineitem").schema
    arriving = stream.read_table_stream(spark, f"{folder}/lineitem.parquet", schema).select(
        "l_orderkey", "l_linenumber", *[F.expr(x).alias(name) for name, x in _NUMBERS.items()]
    )
    blended = stream.blend_stream(arriving, {n: n for n in fv.LAYER_WEIGHTS}, gw.effective_weights())
    target = work_dir(spark, "blended")
    running = (
        blended.writeStream.format("parquet")
        .option("checkpointLocation", work_dir(spark, "progress"))
        .trigger(availableNow=True)
        .start(target)
    )
    running.awaitTermination()
    return spark.read.parquet(target)
