"""Secrets in texts, and credentials whose parts only mean something together.

*Strong* spans are reported wherever they stand: assignments of passwords and keys, access key ids, long
hexadecimal strings. *Weak* candidates say little alone: a login, an endpoint, a random-looking word. They are
linked by an interval join: every identifier and every secret opens a scope of ``SCOPE`` characters before and
after it, and a weak candidate is reported only if the parts that complete it reach into its scope:

| weak kind | reported with |
|---|---|
| login | a secret: assign, hex or blob |
| blob | an identifier: access or login |
| endpoint | both |

Weak candidates that touch a strong span are part of it and are dropped.

Everything is Spark SQL. Positions come from the text cut at the matches: the gaps and matches before a match
sum up to its start, as a running sum over rows. Scopes are cut into blocks of their length, which makes the
interval join an equality join with a condition; a candidate is kept once whatever number of parts it meets.
Only rows with matches move, without their texts; copies of a text collapse before they move.

Null texts have no spans. Repeated rows stay, and a text that very many rows have is joined where they lie. Very long
texts are rows like others; patterns take runs whole. Empty tables give empty results. Other columns may have any
names; one called spans gives way. Positions are code points, ends exclusive.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sluicegate.llm.common import join_hot, sheltered
from sluicegate.session import stored

SCOPE = 200


def either_case(word: str) -> str:
    return "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in word)


_KEYS = "|".join(map(either_case, ("password", "passwd", "secret", "token", "api_?key")))
_LOGINS = "|".join(map(either_case, ("username", "user", "login", "account", "client_?id")))
_GIVES = r"""["']?\x20*[:=]\x20*["']?"""
# Kind, pattern, group of the value and its least length. The patterns of access and hex take runs whole.
STRONG = (
    ("assign", rf"({_KEYS}){_GIVES}([A-Za-z0-9+/_.=-]+)", 2, 12),
    ("access", r"AKIA[A-Z0-9]{14,}", 0, 18),
    ("hex", r"[0-9a-f]{16,}", 0, 16),
)
WEAK = (
    ("login", rf"({_LOGINS}){_GIVES}([A-Za-z0-9_.@-]+)", 2, 3),
    ("blob", r"[A-Za-z0-9+/_-]{20,}", 0, 20),
    ("endpoint", r"https?://[A-Za-z0-9.-]+(:[0-9]+)?(/[A-Za-z0-9_./-]*)?", 0, 10),
)
# A blob counts if it has all of these.
BLOB_PARTS = ("[0-9]", "[A-Z]", "[a-z]")
ORDER = [kind for kind, *_ in (*STRONG, *WEAK)]
IDENTIFIERS = ("access", "login")
SECRETS = ("assign", "hex", "blob")


def _pieces(text: Column, kind: str, pattern: str, group: int, least: int) -> Column:
    """kind, gaps (lengths), sizes of the matches, and which of them count; null without a match."""
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    values = F.regexp_extract_all(text, F.lit(pattern), F.lit(group)) if group else found

    def counts(value: Column) -> Column:
        result = F.length(value) >= least
        for part in BLOB_PARTS if kind == "blob" else ():
            result = result & value.rlike(part)
        return result

    return F.when(
        text.rlike(pattern),
        F.struct(
            F.lit(kind).alias("kind"),
            F.transform(F.split(text, pattern, -1), F.length).alias("gaps"),
            F.transform(found, F.length).alias("sizes"),
            F.transform(values, counts).alias("counts"),
        ),
    )


def scan(docs: DataFrame, keep: list[str], text: str) -> DataFrame:
    """The columns ``keep``, text_key and pieces of the rows that have matches (else null), stored."""
    value = F.col("row text")
    strong = [_pieces(value, *rule) for rule in STRONG]
    # Weak parts matter only beside an identifier or a login.
    can_link = value.rlike(STRONG[1][1]) | value.rlike(WEAK[0][1])
    weak = [F.when(can_link, _pieces(value, *rule)) for rule in WEAK]
    found = F.array_compact(F.array(*strong, *weak))
    named = docs.select(*[f"`{c}`" for c in keep], F.col(f"`{text}`").alias("row text"))
    pieces = named.withColumn("pieces", found)
    has = F.size("pieces") > 0
    return stored(
        pieces.select(
            *[f"`{c}`" for c in keep],
            F.when(has, F.sha2(value.cast("binary"), 256)).alias("text_key"),
            F.when(has, F.col("pieces")).alias("pieces"),
        ),
        "secret-pieces",
    )


def located(scanned: DataFrame) -> DataFrame:
    """text_key, kind, begin, until of every match that counts, of every different text."""
    texts = scanned.filter("text_key is not null").groupBy("text_key").agg(F.first("pieces").alias("pieces"))
    kinds = texts.select("text_key", F.explode("pieces").alias("p"))
    rows = kinds.select(
        "text_key",
        F.col("p.kind").alias("kind"),
        F.posexplode(F.arrays_zip(F.slice("p.gaps", 1, F.size("p.sizes")).alias("gap"), "p.sizes", "p.counts")).alias(
            "n", "m"
        ),
    ).select("text_key", "kind", "n", F.col("m.gap").alias("gap"), F.col("m.sizes").alias("size"), "m.counts")
    so_far = Window.partitionBy("text_key", "kind").orderBy("n").rowsBetween(Window.unboundedPreceding, 0)
    ends = rows.withColumn("until", F.sum(F.col("gap") + F.col("size")).over(so_far))
    return ends.filter("counts").select(
        "text_key", "kind", (F.col("until") - F.col("size")).alias("begin"), "until"
    )


def _reaching(candidates: DataFrame, parts: DataFrame, reach: int) -> DataFrame:
    """Candidates with a part within ``reach`` characters: an interval join by blocks."""
    block = max(reach, 1) * 2

    def blocks(begin: Column, until: Column) -> Column:
        return F.explode(F.sequence(F.floor(begin / block), F.floor(until / block))).alias("block")

    wide = candidates.select(
        "text_key", "kind", "begin", "until", blocks(F.col("begin") - reach, F.col("until") + reach)
    )
    other = parts.select(
        "text_key", F.col("begin").alias("b"), F.col("until").alias("u"), blocks(F.col("begin"), F.col("until"))
    )
    near = (F.col("b") < F.col("until") + reach) & (F.col("u") > F.col("begin") - reach)
    met = wide.alias("c").join(
        other.alias("p"),
        (F.col("c.text_key") == F.col("p.text_key")) & (F.col("c.block") == F.col("p.block")) & near,
        "left_semi",
    )
    return met.select("text_key", "kind", "begin", "until").distinct()


def linked(spans: DataFrame, scope: int = SCOPE) -> DataFrame:
    """The weak spans whose complementary parts are in scope."""
    strong_kinds = [kind for kind, *_ in STRONG]
    strong = spans.filter(F.col("kind").isin(strong_kinds))
    weak = spans.filter(~F.col("kind").isin(strong_kinds))
    inside = _reaching(weak, strong, 0)
    alone = stored(weak.join(inside, ["text_key", "kind", "begin", "until"], "left_anti"), "weak")
    if alone.isEmpty():
        return alone
    parts = strong.unionByName(alone)
    identifiers = parts.filter(F.col("kind").isin(*IDENTIFIERS))
    secrets = parts.filter(F.col("kind").isin(*SECRETS))
    endpoints = alone.filter("kind = 'endpoint'")
    return (
        _reaching(alone.filter("kind = 'login'"), secrets, scope)
        .unionByName(_reaching(alone.filter("kind = 'blob'"), identifiers, scope))
        .unionByName(_reaching(_reaching(endpoints, identifiers, scope), secrets, scope))
    )


def find_secrets(docs: DataFrame, text: str = "text", keep: list[str] | None = None, scope: int = SCOPE) -> DataFrame:
    """The columns ``keep`` (all but the text), and spans: kind, begin, until by begin, then kind as listed."""
    kept = [c for c in (docs.columns if keep is None else keep) if c != text]

    def work(frame: DataFrame, names: dict[str, str]) -> DataFrame:
        return _find_secrets(frame, names[text], [names[c] for c in kept], scope)

    return sheltered(docs, work, kept, (text,))


def _find_secrets(docs: DataFrame, text: str, names: list[str], scope: int) -> DataFrame:
    scanned = scan(docs, names, text)
    spans = stored(located(scanned), "spans")
    strong = spans.filter(F.col("kind").isin([kind for kind, *_ in STRONG]))
    order = F.array_position(F.lit(ORDER), F.col("kind"))
    by_text = (
        strong.unionByName(linked(spans, scope))
        .groupBy("text_key")
        .agg(F.array_sort(F.collect_list(F.struct("begin", order.alias("place"), "until"))).alias("all"))
    )
    made = F.transform(
        "all",
        lambda x: F.struct(
            F.get(F.lit(ORDER), (x["place"] - 1).cast("int")).alias("kind"), x["begin"].alias("begin"), x["until"].alias("until")
        ),
    )
    rows = scanned.filter("text_key is not null").groupBy("text_key").agg(F.count("*").alias("rows of the text"))
    by_text = rows.join(by_text.select("text_key", made.alias("spans")), "text_key", "left")
    by_text = stored(by_text, "spans-by-text")
    none = F.array().cast("array<struct<kind:string,begin:bigint,until:bigint>>")
    plain = scanned.filter("text_key is null").select(*[f"`{c}`" for c in names], none.alias("spans"))
    found = join_hot(
        scanned.filter("text_key is not null").drop("pieces"), by_text, "text_key", "rows of the text"
    ).select(*[f"`{c}`" for c in names], F.coalesce("spans", none).alias("spans"))
    return plain.unionByName(found)


def summary(found: DataFrame) -> dict[str, Column]:
    """Digest columns of a frame with spans: numbers per strong kind, base_sha256 and all spans as text."""

    def written(spans: Column) -> Column:
        parts = F.transform(
            spans, lambda x: F.concat_ws(":", x["kind"], x["begin"].cast("string"), x["until"].cast("string"))
        )
        return F.array_join(parts, ",")

    def of(kind: str):
        return lambda x: x["kind"] == kind

    kinds = [kind for kind, *_ in STRONG]
    base = F.filter("spans", lambda x: x["kind"].isin(kinds))
    numbers = {f"n_{kind}": F.size(F.filter("spans", of(kind))).cast("long") for kind in kinds}
    return {
        **numbers,
        "base_sha256": F.sha2(written(base).cast("binary"), 256),
        "spans": written(F.col("spans")),
    }
