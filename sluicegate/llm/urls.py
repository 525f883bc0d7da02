"""URL verdicts: fixed host and path rules, and association rules mined from what these decide.

The rules label the urls they fit. Each url is a basket of tokens (scheme, host labels, registered domain, path
words, file ending, query names), and FP-growth mines the combinations that go with a label. A mined rule counts
if ``LEAST_SUPPORT`` of the labelled urls, and ``LEAST_ROWS`` of them, have it and ``LEAST_CONFIDENCE`` of those with its tokens have its
label, and if no rule with fewer of its tokens is as confident. Urls that no fixed rule fits take the verdict of
the mined rule with the highest confidence, then most tokens, then most support, then blocking; without any,
they are allowed.

Rules lie in an inverted index under their rarest token: a url's tokens are joined with it and the other tokens
of a rule are then compared. Everything goes by different urls, so a page that many rows have counts there once;
mining counts every row.

Null urls and urls without ``://`` have an empty host and path, no rule and no tokens: they are allowed. Without
``LEAST_ROWS`` labelled urls nothing is mined. Repeated rows stay. Very long urls are rows like others, with as many
tokens as they have parts. Empty tables give empty results. Other columns may have any names; those of added columns
give way.
"""

from __future__ import annotations

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sluicegate.llm.common import sheltered
from sluicegate.session import stored

LEAST_SUPPORT = 0.01
# However few urls are labelled, a rule needs so many.
LEAST_ROWS = 20
LEAST_CONFIDENCE = 0.9
# Verdict, host, start of the path.
RULES = (
    ("block", "net", "/"),
    ("allow", "example.net", "/en/"),
    ("block", "example.com", "/de/"),
    ("allow", "org", "/fr/"),
)
LABEL = "label="


def host_of(url: Column) -> Column:
    """After the first :// up to /, ?, # or the end, with A-Z in lower case."""
    rest = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    return F.translate(F.coalesce(rest, F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path_of(url: Column) -> Column:
    """After the host up to ?, # or the end."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_of(host: Column, path: Column, rules: tuple = RULES) -> Column:
    """name, verdict of the longest rule that fits; null without one. Of equals the first one listed."""
    result = F.lit(None).cast("struct<rule:string,verdict:string>")
    ordered = sorted(rules, key=lambda rule: -len(rule[1] + rule[2]))
    for verdict, suffix, start in reversed(ordered):
        fits = ((host == suffix) | host.endswith("." + suffix)) & path.startswith(start)
        value = F.struct(F.lit(suffix + start).alias("rule"), F.lit(verdict).alias("verdict"))
        result = F.when(fits, value).otherwise(result)
    return result


def tokens_of(url: Column, host: Column, path: Column) -> Column:
    """Different tokens of a url, sorted; numbers count as one word."""

    def named(prefix: str, values: Column) -> Column:
        cleaned = F.filter(values, lambda x: x != "")
        words = F.transform(cleaned, lambda x: F.regexp_replace(F.lower(x), r"[0-9]+", "#"))
        return F.transform(words, lambda x: F.concat(F.lit(prefix), x))

    labels = F.split(host, r"\.")
    scheme = F.array(F.regexp_extract(url, r"(?s)^([^:/?#]*)://", 1))
    ending = F.array(F.regexp_extract(path, r"\.([A-Za-z0-9]{1,5})$", 1))
    query = F.regexp_extract(url, r"(?s)^[^?#]*\?([^#]*)", 1)
    names = F.transform(F.split(query, "&"), lambda x: F.regexp_extract(x, r"^([^=]*)", 1))
    domain = F.array(F.regexp_extract(host, r"([^.]+\.[^.]+)$", 1))
    every = F.concat(
        named("scheme=", scheme),
        named("host=", labels),
        named("domain=", domain),
        named("path=", F.split(F.regexp_replace(path, r"\.[A-Za-z0-9]{1,5}$", ""), "[/_.-]+")),
        named("ending=", ending),
        named("query=", names),
        F.when(F.instr(url, "#") > 0, F.array(F.lit("fragment"))).otherwise(F.array().cast("array<string>")),
    )
    return F.when(host != "", F.array_sort(F.array_distinct(every))).otherwise(F.array().cast("array<string>"))


def parse(pages: DataFrame, url: str = "url") -> DataFrame:
    """url, host, path, fixed, tokens of every row."""
    named = pages.select(F.col(f"`{url}`").alias("url"))
    parsed = named.withColumns({"host": host_of(F.col("url")), "path": path_of(F.col("url"))})
    fixed = rule_of(F.col("host"), F.col("path"))
    return parsed.withColumns(
        {"fixed": fixed, "tokens": tokens_of(F.col("url"), F.col("host"), F.col("path"))}
    )


def mine(
    labelled: DataFrame,
    least_support: float = LEAST_SUPPORT,
    least_confidence: float = LEAST_CONFIDENCE,
) -> DataFrame:
    """rule_id, antecedent, verdict, confidence, support, rarest: pruned rules of rows (tokens, verdict)."""
    spark = labelled.sparkSession
    schema = (
        "rule_id long, antecedent array<string>, verdict string, confidence double, support double, rarest string"
    )
    baskets = labelled.select(
        F.array_append("tokens", F.concat(F.lit(LABEL), F.col("verdict"))).alias("items")
    )
    baskets = stored(baskets, "baskets")
    rows = baskets.count()
    if rows < LEAST_ROWS:
        return spark.createDataFrame([], schema)
    least_support = max(least_support, LEAST_ROWS / rows)
    model = FPGrowth(itemsCol="items", minSupport=least_support, minConfidence=least_confidence).fit(baskets)
    consequent = F.get("consequent", F.lit(0))
    found = model.associationRules.filter(
        consequent.startswith(LABEL) & ~F.exists("antecedent", lambda x: x.startswith(LABEL))
    ).select(
        F.array_sort("antecedent").alias("antecedent"),
        F.substring(consequent, len(LABEL) + 1, 100).alias("verdict"),
        "confidence",
        "support",
    )
    found = stored(found.withColumn("rule_id", F.xxhash64("antecedent", "verdict")), "mined")
    # A rule is needless if another one with some of its tokens is as confident of the same verdict.
    general = found.select(
        F.col("antecedent").alias("fewer"), F.col("confidence").alias("sure"), "verdict",
        F.get("antecedent", F.lit(0)).alias("token"),
    )
    needless = (
        found.select("rule_id", "antecedent", "verdict", "confidence", F.explode("antecedent").alias("token"))
        .join(general, ["token", "verdict"])
        .filter(
            (F.size("fewer") < F.size("antecedent"))
            & (F.col("sure") >= F.col("confidence"))
            & (F.size(F.array_except("fewer", "antecedent")) == 0)
        )
        .select("rule_id")
    )
    needed = found.join(needless.distinct(), "rule_id", "left_anti")
    singles = model.freqItemsets.filter(F.size("items") == 1).select(
        F.get("items", F.lit(0)).alias("token"), F.col("freq").alias("n")
    )
    rarest = (
        needed.select("rule_id", F.explode("antecedent").alias("token"))
        .join(singles, "token")
        .groupBy("rule_id")
        .agg(F.min(F.struct("n", "token")).alias("least"))
        .select("rule_id", F.col("least.token").alias("rarest"))
    )
    rules = needed.join(rarest, "rule_id")
    return stored(rules.select(*[part.split(" ")[0] for part in schema.split(", ")]), "rules")


def match(urls: DataFrame, rules: DataFrame) -> DataFrame:
    """url, mined, confidence: the best mined rule's verdict for urls (url, tokens) that have any."""
    looked_up = urls.select("url", "tokens", F.explode("tokens").alias("rarest")).join(rules, "rarest")
    fitting = looked_up.filter(F.size(F.array_except("antecedent", "tokens")) == 0)
    order = F.struct(
        "confidence", F.size("antecedent").alias("size"), "support", F.col("verdict").alias("mined"), "rule_id"
    )
    best = fitting.groupBy("url").agg(F.max(order).alias("best"))
    return best.select("url", F.col("best.mined").alias("mined"), F.col("best.confidence").alias("confidence"))


def judge(pages: DataFrame, keep: list[str] | None = None, url: str = "url") -> DataFrame:
    """The columns ``keep``, host, path, rule (null if no fixed rule fits) and verdict of every row."""

    def work(frame: DataFrame, names: dict[str, str]) -> DataFrame:
        return _judge(frame, [names[c] for c in (pages.columns if keep is None else keep)], names[url])

    return sheltered(pages, work, keep, (url,))


def _judge(pages: DataFrame, names: list[str], url: str) -> DataFrame:
    parsed = parse(pages, url)
    labelled = parsed.filter("fixed is not null").select("tokens", F.col("fixed.verdict").alias("verdict"))
    rules = mine(labelled)
    open_urls = parsed.filter("fixed is null and host <> ''").select("url", "tokens").distinct()
    mined = stored(match(open_urls, rules).select(F.col("url").alias("mined url"), "mined"), "verdicts")
    rows = pages.select(*[f"`{c}`" for c in names], F.col(f"`{url}`").alias("mined url")).withColumns(
        {"host": host_of(F.col("mined url")), "path": path_of(F.col("mined url"))}
    )
    fixed = rule_of(F.col("host"), F.col("path"))
    return (
        rows.withColumn("fixed rule", fixed)
        .join(mined, "mined url", "left")
        .select(
            *[f"`{c}`" for c in names],
            "host",
            "path",
            F.col("fixed rule.rule").alias("rule"),
            F.coalesce("fixed rule.verdict", "mined", F.lit("allow")).alias("verdict"),
        )
    )
