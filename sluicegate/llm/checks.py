"""DuckDB SQL for the queries that SQL can state: written from the rules, over the given tables."""

from __future__ import annotations

from sluicegate.llm import quality, secrets

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _literal(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


DECONTAMINATION = rf"""
WITH docs AS (
  SELECT row_number() OVER () AS r, doc_id,
    coalesce(regexp_extract_all(translate(text, '{UPPER}', '{LOWER}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) AS w
  FROM documents
), items AS (
  SELECT item_id,
    coalesce(regexp_extract_all(translate(text, '{UPPER}', '{LOWER}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) AS w
  FROM benchmark
), windows AS (
  SELECT DISTINCT item_id, len, unnest(list_transform(range(1, len(w) - len + 2),
      lambda i: array_to_string(list_slice(w, i, i + len - 1), ' '))) AS win
  FROM (SELECT *, least(len(w), 10) AS len FROM items WHERE len(w) > 0)
), places AS (
  SELECT r, len, unnest(range(1, len(w) - len + 2)) AS p,
    unnest(list_transform(range(1, len(w) - len + 2),
      lambda i: array_to_string(list_slice(w, i, i + len - 1), ' '))) AS win
  FROM docs, (SELECT DISTINCT len FROM windows) WHERE len(w) >= len
), found AS (
  SELECT DISTINCT r, p, places.len, item_id FROM places JOIN windows USING (len, win)
), covered AS (
  SELECT r, count(DISTINCT q) AS n_hit FROM (SELECT r, unnest(range(p, p + len)) AS q FROM found) GROUP BY r
), named AS (
  SELECT r, count(DISTINCT item_id) AS n_items,
    string_agg(DISTINCT item_id::VARCHAR, ',' ORDER BY item_id::VARCHAR) AS ids
  FROM found GROUP BY r
)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
  sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM docs LEFT JOIN covered USING (r) LEFT JOIN named USING (r)
"""

_SHARES = {
    "symbols": "(10000 * n_symbols) // greatest(word_chars, 1)",
    "punctuation": "(10000 * n_punctuation) // greatest(word_chars, 1)",
    "capitals": "(10000 * n_capitals) // greatest(word_chars, 1)",
    "repeats": "(10000 * n_repeat_words) // greatest(n_words, 1)",
    "dup_lines": "(10000 * n_dup_lines) // greatest(n_lines, 1)",
    "word_length": "(100 * word_chars) // greatest(n_words, 1)",
}


def _quartiles(name: str, keys: str) -> str:
    by = f"{keys}, " if keys else ""
    return f"""{name} AS (
  SELECT {by}share, any_value(total) AS total, min(CASE WHEN 4 * upto >= total THEN bucket END) AS q1,
    min(CASE WHEN 4 * upto >= 3 * total THEN bucket END) AS q3
  FROM (SELECT {by}share, bucket, sum(n) OVER (PARTITION BY {by}share ORDER BY bucket) AS upto,
          sum(n) OVER (PARTITION BY {by}share) AS total
        FROM (SELECT {by}share, bucket, count(*) AS n FROM cells GROUP BY {by}share, bucket))
  GROUP BY {by}share
)"""


def _quality() -> str:
    cells = " UNION ALL ".join(
        f"SELECT language, origin, '{name}' AS share, {value} AS v FROM counts WHERE n_words > 0"
        for name, value in _SHARES.items()
    )
    least = " ".join(f"WHEN '{name}' THEN {value}" for name, value in quality.SHARES.items())
    tests = " UNION ALL ".join(
        f"SELECT r, language, origin, '{name}' AS share, {value} AS v FROM counts" for name, value in _SHARES.items()
    )
    return rf"""
WITH split AS (
  SELECT row_number() OVER () AS r, doc_id,
    coalesce('=' || lang, 'null') AS language, coalesce('=' || source, 'null') AS origin, coalesce(text, '') AS t,
    list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w,
    list_filter(string_split(coalesce(text, ''), chr(10)),
      lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines
  FROM documents
), places AS (
  SELECT r, unnest(range(1, len(w) - 3)) AS p,
    unnest(list_transform(range(1, len(w) - 3), lambda i: array_to_string(list_slice(w, i, i + 4), ' '))) AS win
  FROM split WHERE len(w) >= 5
), repeated AS (
  SELECT r, count(DISTINCT q) AS n FROM (
    SELECT r, unnest(range(p, p + 5)) AS q
    FROM (SELECT r, p, count(*) OVER (PARTITION BY r, win) AS times FROM places) WHERE times > 1
  ) GROUP BY r
), counts AS (
  SELECT r, doc_id, language, origin, len(w)::BIGINT AS n_words, length(array_to_string(w, ''))::BIGINT AS word_chars,
    length(regexp_replace(t, '[^#*$%&|<>]+', '', 'g'))::BIGINT AS n_symbols,
    length(regexp_replace(t, '[^!-/:-@\[-`{{-~]+', '', 'g'))::BIGINT AS n_punctuation,
    length(regexp_replace(t, '[^A-Z]+', '', 'g'))::BIGINT AS n_capitals,
    len(lines)::BIGINT AS n_lines, (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines,
    coalesce(n, 0)::BIGINT AS n_repeat_words
  FROM split LEFT JOIN repeated USING (r)
), cells AS (
  SELECT language, origin, share, (v >> greatest(length(bin(v)) - 6, 0)) << greatest(length(bin(v)) - 6, 0) AS bucket
  FROM ({cells})
), {_quartiles("own", "language, origin")}, {_quartiles("wider", "language")}, {_quartiles("whole", "")},
chosen AS (
  SELECT own.language, own.origin, own.share,
    CASE WHEN own.total >= {quality.LEAST_ROWS} THEN own.q1 WHEN wider.total >= {quality.LEAST_ROWS} THEN wider.q1
      ELSE whole.q1 END AS q1,
    CASE WHEN own.total >= {quality.LEAST_ROWS} THEN own.q3 WHEN wider.total >= {quality.LEAST_ROWS} THEN wider.q3
      ELSE whole.q3 END AS q3
  FROM own JOIN wider USING (language, share) JOIN whole USING (share)
), fences AS (
  SELECT *, greatest({quality.REACH} * (q3 - q1), CASE share {least} END) AS reach FROM chosen
), verdicts AS (
  SELECT r, bool_and(v <= q3 + reach AND (share <> 'word_length' OR v >= q1 - reach)) AS within
  FROM ({tests}) JOIN fences USING (language, origin, share) GROUP BY r
), judged AS (
  SELECT *, n_words < {quality.LEAST_WORDS}
    OR 100 * n_repeat_words > {quality.MOST_REPEATED} * n_words AS base_failed
  FROM counts
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND coalesce(within, FALSE) AS kept
FROM judged LEFT JOIN verdicts USING (r)
"""


def _secrets() -> str:
    parts = []
    for kind, pattern, group, least in (*secrets.STRONG, *secrets.WEAK):
        value = f"regexp_extract_all(t, {_literal(pattern)}, {group})"
        more = "".join(f" AND regexp_matches(v, '{part}')" for part in secrets.BLOB_PARTS) if kind == "blob" else ""
        parts.append(f"""
  SELECT r, '{kind}' AS kind, {secrets.ORDER.index(kind)} AS place, until - length(m) AS b, until AS u
  FROM (SELECT r, m, v, sum(length(g) + length(m)) OVER (PARTITION BY r ORDER BY n) AS until
    FROM (SELECT r, unnest(range(len({value}))) AS n, unnest({value}) AS v,
        unnest(regexp_extract_all(t, {_literal(pattern)})) AS m,
        unnest(list_slice(regexp_split_to_array(t, {_literal(pattern)}), 1, len({value}))) AS g
      FROM docs))
  WHERE length(v) >= {least}{more}""")

    def near(other: str, reach: int) -> str:
        return f"{other}.r = c.r AND {other}.b < c.u + {reach} AND {other}.u > c.b - {reach}"

    def kinds(names) -> str:
        return ", ".join(f"'{name}'" for name in names)

    strong = kinds(kind for kind, *_ in secrets.STRONG)
    scope = secrets.SCOPE
    identifier = f"EXISTS (SELECT 1 FROM parts p WHERE p.kind IN ({kinds(secrets.IDENTIFIERS)}) AND {near('p', scope)})"
    secret = f"EXISTS (SELECT 1 FROM parts p WHERE p.kind IN ({kinds(secrets.SECRETS)}) AND {near('p', scope)})"
    numbers = ", ".join(
        f"(count(*) FILTER (WHERE kind = '{kind}'))::BIGINT AS n_{kind}" for kind, *_ in secrets.STRONG
    )
    numbers_or_none = ", ".join(f"coalesce(n_{kind}, 0) AS n_{kind}" for kind, *_ in secrets.STRONG)
    written = "kind || ':' || b || ':' || u"
    return f"""
WITH docs AS (
  SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents
), spans AS ({" UNION ALL ".join(parts)}
), linkable AS (
  SELECT DISTINCT r FROM docs WHERE regexp_matches(t, {_literal(secrets.STRONG[1][1])})
    OR regexp_matches(t, {_literal(secrets.WEAK[0][1])})
), parts AS (
  SELECT * FROM spans WHERE kind IN ({strong})
  UNION ALL
  SELECT * FROM spans c WHERE kind NOT IN ({strong}) AND r IN (SELECT r FROM linkable)
    AND NOT EXISTS (SELECT 1 FROM spans s WHERE s.kind IN ({strong}) AND {near('s', 0)})
), reported AS (
  SELECT * FROM parts c WHERE kind IN ({strong})
    OR kind = 'login' AND {secret} OR kind = 'blob' AND {identifier}
    OR kind = 'endpoint' AND {secret} AND {identifier}
), texts AS (
  SELECT r, {numbers},
    string_agg({written}, ',' ORDER BY b, place) FILTER (WHERE kind IN ({strong})) AS base,
    string_agg({written}, ',' ORDER BY b, place) AS spans
  FROM reported GROUP BY r
)
SELECT doc_id, {numbers_or_none}, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM docs LEFT JOIN texts USING (r)
"""


CORPUS_CHECKS = {
    "op4_quality": _quality(),
    "op8_decontamination": DECONTAMINATION,
    "op9_secrets": _secrets(),
}
