"""SQL fragments the check queries are composed of."""

from __future__ import annotations

import string

from sluicegate import fixed_values as fv
from sluicegate.catalog import tables as tb
from sluicegate.functions.draws import LOW_BITS, MODULUS, stream
from sluicegate.functions.embedding import DIMENSIONS
from sluicegate.operators import mutation as mu

SPACE_CLASS = (
    r"[\t-\r\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
)


def quote(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def values(rows: list[tuple]) -> str:
    def cell(value):
        return quote(value) if isinstance(value, str) else f"{value}::DOUBLE" if isinstance(value, float) else str(value)

    return "(VALUES " + ", ".join("(" + ", ".join(map(cell, row)) + ")" for row in rows) + ")"


def strip(x: str) -> str:
    return rf"regexp_replace({x}, '\A{SPACE_CLASS}+|{SPACE_CLASS}+\z', '', 'g')"


def words(x: str) -> str:
    return f"list_filter(string_split_regex({x}, '{SPACE_CLASS}+'), lambda w: w <> '')"


# -- normalisation ----------------------------------------------------------


def leet(x: str) -> str:
    return f"translate({x}, '{fv.LEET_FROM}', '{fv.LEET_TO}')"


def ascii_fold(x: str) -> str:
    return rf"regexp_replace(strip_accents({x}), '[^\x00-\x7F]', '', 'g')"


def separators(x: str) -> str:
    return f"translate({x}, '_-.', '   ')"


def camel(x: str) -> str:
    return rf"regexp_replace({x}, '([a-z])([A-Z])', '\1 \2', 'g')"


def join_letters(x: str) -> str:
    """Mark single characters, then the gaps between two of them, then drop the gaps' blanks."""
    x = rf"regexp_replace({x}, '\b([A-Za-z0-9])\b', chr(1) || '\1' || chr(2), 'g')"
    x = rf"regexp_replace({x}, '\x02([\t-\r\x1c-\x20]+)\x01', chr(3) || '\1' || chr(4), 'g')"
    for _ in range(4):  # a gap may hold several runs of blanks
        x = rf"regexp_replace({x}, '\x03([^ \x04]*) +', chr(3) || '\1', 'g')"
    return f"translate({x}, chr(1) || chr(2) || chr(3) || chr(4), '')"


def stutter(x: str) -> str:
    for char in string.ascii_letters + string.digits:
        x = f"regexp_replace({x}, '{char}{{3,}}', '{char}', 'g')"
    for char in sorted(set(map(chr, range(128))) - set(string.ascii_letters + string.digits) - {"\n", "\0"}):
        one = "chr(92) || chr(92)" if char == "\\" else f"chr({ord(char)})"
        x = f"regexp_replace({x}, '\\x{ord(char):02x}{{3,}}', {one}, 'g')"
    return x


def normalize(x: str) -> str:
    return stutter(join_letters(camel(separators(ascii_fold(leet(x))))))


PROMPTS = """prompts AS (
  SELECT 'd:' || doc_id AS prompt_id, text AS prompt FROM documents
  UNION ALL
  SELECT 'c:' || conv_id || ':' || turn, text FROM conversations WHERE role = 'user')"""

# tokens: prompt_id, pos, form, token (the form's base word)
TOKENS = f"""{PROMPTS},
lemmas(form, lemma) AS {values(tb.lemma_rows())},
forms AS (
  SELECT prompt_id, unnest(range(len(list))) AS pos, unnest(list) AS form FROM (
    SELECT prompt_id,
           list_filter(string_split_regex(lower({normalize("prompt")}), '[^a-z0-9]+'), lambda t: t <> '') AS list
    FROM prompts)),
tokens AS (
  SELECT prompt_id, pos, f.form, coalesce(lemma, f.form) AS token
  FROM forms f LEFT JOIN lemmas l ON f.form = l.form)"""


def lcs(a: str, b: str) -> str:
    """Longest common subsequence of two strings, one table row per character of the first."""
    cell = (
        f"CASE WHEN substr({b}, j[1], 1) = chr(c[1]) THEN row[j[1]] + 1 "
        "ELSE greatest(row[j[1] + 1], done[j[1]]) END"
    )
    inner = (
        f"list_reduce(list_transform(range(1, length({b}) + 1), lambda k: [k::INTEGER]), "
        f"lambda done, j: list_append(done, ({cell})::INTEGER), [0::INTEGER])"
    )
    return (
        f"list_last(list_reduce(list_transform(string_split({a}, ''), lambda s: [unicode(s)::INTEGER]), "
        f"lambda row, c: {inner}, list_transform(range(length({b}) + 1), lambda z: 0::INTEGER)))"
    )


# matches: prompt_id, term, weight, is_exact, token, ratio
MATCHES = f"""{TOKENS},
lexicon(term, weight, category) AS {values(tb.merged_rows())},
seen AS (SELECT prompt_id, token, min(pos) AS pos FROM tokens GROUP BY ALL),
vocabulary AS (SELECT DISTINCT token FROM seen),
exact AS (
  SELECT prompt_id, term, weight, token FROM seen JOIN lexicon ON token = term),
near AS (
  SELECT token, term, weight, 200.0 * {lcs("token", "term")} / (length(token) + length(term)) AS ratio
  FROM (SELECT token, term, weight FROM vocabulary, lexicon
        WHERE length(term) > 4 AND token <> term
          AND abs(length(token) - length(term)) <= 0.15 * (length(token) + length(term))
          AND levenshtein(token, term) <= 0.15 * (length(token) + length(term)))),
fuzzy AS (
  SELECT s.prompt_id, n.term, any_value(n.weight) AS weight, max(n.ratio) AS ratio,
         arg_min(s.token, struct_pack(r := -n.ratio, p := s.pos)) AS token
  FROM seen s JOIN near n ON s.token = n.token AND n.ratio >= 85
  WHERE NOT EXISTS (SELECT 1 FROM exact e WHERE e.prompt_id = s.prompt_id AND e.term = n.term)
  GROUP BY s.prompt_id, n.term),
matches AS (
  SELECT prompt_id, term, weight, TRUE AS is_exact, token, 100.0::DOUBLE AS ratio FROM exact
  UNION ALL SELECT prompt_id, term, weight, FALSE, token, ratio FROM fuzzy)"""

# lexicon_scores: prompt_id, lexicon_score, triggers
LEXICON_SCORES = f"""{MATCHES},
hits AS (
  SELECT prompt_id, least(sum(weight::DECIMAL(18,9))::DOUBLE, 1.0) AS lexicon_score,
         string_agg(CASE WHEN is_exact THEN term ELSE term || ' (matched: ''' || token || ''')' END, '|'
           ORDER BY CASE WHEN is_exact THEN term ELSE term || ' (matched: ''' || token || ''')' END) AS triggers
  FROM matches GROUP BY prompt_id),
lexicon_scores AS (
  SELECT prompt_id, coalesce(lexicon_score, 0.0) AS lexicon_score, coalesce(triggers, '') AS triggers
  FROM prompts LEFT JOIN hits USING (prompt_id))"""

# -- sentences and nearest signatures ---------------------------------------

SENTENCE_LIST = r"string_split(regexp_replace(prompt, '([.!?]) +', '\1' || chr(1), 'g'), chr(1))"
# pieces: prompt_id, pos, text; pos 0 is the whole prompt, then its chunks
PIECES = f"""sentences AS (
  SELECT prompt_id, unnest(range(len(list))) AS spot, unnest(list) AS sentence
  FROM (SELECT prompt_id, {SENTENCE_LIST} AS list FROM prompts)),
chunks AS (
  SELECT prompt_id, spot, k, CASE WHEN len(w) > {fv.WORDS_PER_CHUNK}
           THEN array_to_string(w[k * {fv.WORDS_PER_CHUNK} + 1 : (k + 1) * {fv.WORDS_PER_CHUNK}], ' ')
           ELSE sentence END AS chunk
  FROM (SELECT *, unnest(range(greatest(1, CASE WHEN len(w) > {fv.WORDS_PER_CHUNK}
                   THEN ceil(len(w) / {fv.WORDS_PER_CHUNK})::BIGINT ELSE 1 END))) AS k
        FROM (SELECT *, {words("sentence")} AS w FROM sentences))),
kept AS (
  SELECT prompt_id, row_number() OVER (PARTITION BY prompt_id ORDER BY spot, k) AS pos, text
  FROM (SELECT prompt_id, spot, k, {strip("chunk")} AS text FROM chunks) WHERE text <> ''),
pieces AS (SELECT prompt_id, 0 AS pos, prompt AS text FROM prompts UNION ALL SELECT * FROM kept)"""


def bag(x: str) -> str:
    """A text's bucket numbers."""
    return (
        f"list_transform({words(f'lower({x})')}, "
        f"lambda w: (('0x' || substr(md5(w), 1, 8))::BIGINT % {DIMENSIONS})::INTEGER)"
    )


# nearest: prompt_id, pos, text, sig_id, distance
NEAREST = f"""{PIECES},
piece_texts AS (SELECT DISTINCT text FROM pieces),
piece_bags AS (
  SELECT text, bucket, count(*) AS tf FROM (SELECT text, unnest({bag("text")}) AS bucket FROM piece_texts)
  GROUP BY ALL),
piece_norms AS (SELECT text, sqrt(sum(tf * tf)) AS norm FROM piece_bags GROUP BY text),
sig_bags AS (
  SELECT sig_id, bucket, count(*) AS tf
  FROM (SELECT item_id::VARCHAR AS sig_id, unnest({bag("text")}) AS bucket FROM benchmark) GROUP BY ALL),
sig_norms AS (SELECT sig_id, sqrt(sum(tf * tf)) AS norm FROM sig_bags GROUP BY sig_id),
dots AS (
  SELECT p.text, s.sig_id, sum(p.tf * s.tf) AS dot FROM piece_bags p JOIN sig_bags s USING (bucket)
  GROUP BY ALL),
best AS (
  SELECT text, arg_min(sig_id, struct_pack(d := distance, s := sig_id)) AS sig_id, min(distance) AS distance
  FROM (SELECT d.text, d.sig_id, round(1 - d.dot / (p.norm * s.norm), 12) AS distance
        FROM dots d JOIN piece_norms p ON d.text = p.text JOIN sig_norms s ON d.sig_id = s.sig_id)
  GROUP BY text),
nearest AS (SELECT prompt_id, pos, text, sig_id, distance FROM pieces JOIN best USING (text)),
counted AS (
  SELECT * FROM nearest
  WHERE distance < CASE WHEN pos = 0 THEN {fv.WHOLE_PROMPT_DISTANCE} ELSE {fv.SENTENCE_DISTANCE} END),
similarities AS (
  SELECT prompt_id, CASE WHEN distance IS NULL THEN 0.0 ELSE greatest(0.0, least(1.0, 1.0 - distance)) END::DOUBLE
           AS similarity_score, n_details
  FROM (SELECT p.prompt_id, min(c.distance) AS distance, count(c.distance) AS n_details
        FROM prompts p LEFT JOIN counted c USING (prompt_id) GROUP BY p.prompt_id))"""

# -- variants ---------------------------------------------------------------


def intent(x: str) -> str:
    for pattern in fv.INTENT_PATTERNS:
        x = f"regexp_replace({x}, {quote(pattern.replace(chr(92) + 's', SPACE_CLASS))}, '', 'gi')"
    return x


def strip_intent(x: str) -> str:
    return f"CASE WHEN {intent(x)} <> {x} THEN {strip(intent(x))} ELSE {x} END"


def number(turn: str, j: str, below: str) -> str:
    at = f"(({turn}) * {mu.NUMBERS} + ({j}) + 1)"
    return f"((((start * steps.a[{at}] + steps.c[{at}]) % {MODULUS}) >> {LOW_BITS}) % ({below}))"


_STEPS = stream(mu.STREAMS)
STEPS = (
    "steps AS (SELECT ["
    + ", ".join(str(a) for a, _ in _STEPS)
    + "]::BIGINT[] AS a, ["
    + ", ".join(str(c) for _, c in _STEPS)
    + "]::BIGINT[] AS c)"
)


def typo(x: str, place: str) -> str:
    return (
        f"CASE WHEN length({x}) < 5 THEN {x} ELSE substr({x}, 1, {place}) || substr({x}, {place} + 2, 1) "
        f"|| substr({x}, {place} + 1, 1) || substr({x}, {place} + 3) END"
    )


PREFIXES = "[" + ", ".join(quote(p).replace("\n", "' || chr(10) || '") for p in fv.WRAP_PREFIXES) + "]"
SLOTS = "[" + ", ".join(quote(s) for s in fv.MUTATION_SLOTS) + "]"
_SYNONYM_ROWS = sorted({(w.replace("_", " "), i, lemma) for w, i, lemma in mu.synonym_rows()})
SYNONYMS = f"""synonyms(word, synset_id, lemma) AS {values(_SYNONYM_ROWS)},
members AS (
  SELECT DISTINCT lower(word) AS word, replace(lemma, '_', ' ') AS synonym FROM synonyms
  WHERE lower(replace(lemma, '_', ' ')) <> lower(word)),
options AS (SELECT word, list(synonym ORDER BY synonym) AS list FROM members GROUP BY word)"""

# swaps: prompt_id, turn, text, removed: the synonym swap of every prompt and turn
SWAPS = f"""{STEPS}, {SYNONYMS},
starts AS (
  SELECT prompt_id, prompt, {words("prompt")} AS w,
         ('0x' || substr(md5('42:' || prompt_id), 1, 8))::BIGINT % {MODULUS} AS start
  FROM prompts),
turns AS (
  SELECT s.*, turn, ({SLOTS})[{number("turn", "0", str(len(fv.MUTATION_SLOTS)))} + 1] AS slot
  FROM starts s, steps, range({fv.MUTATION_DRAWS}) t(turn)),
drawn AS (
  SELECT prompt_id, turn, start, j, {number("turn", "j + 2", "len(w)")} AS place,
         w[{number("turn", "j + 2", "len(w)")} + 1] AS word
  FROM turns, steps, range({mu.WORD_DRAWS}) x(j) WHERE len(w) >= 3 AND slot = 'synonym'),
picked AS (
  SELECT d.prompt_id, d.turn, d.start, d.place, length(d.word) AS letters, o.list,
         row_number() OVER (PARTITION BY d.prompt_id, d.turn ORDER BY j) - 1 AS k
  FROM drawn d JOIN options o ON lower(d.word) = o.word WHERE length(d.word) > 3),
replaced AS (
  SELECT prompt_id, turn, k, place, letters,
         list[{number("turn", f"k + {2 + mu.WORD_DRAWS}", "len(list)")} + 1] AS new
  FROM picked, steps WHERE k < {mu.SWAPS}),
pairs AS (
  SELECT prompt_id, turn, sum(letters)::BIGINT AS removed, count(*) AS swaps,
         max(CASE WHEN k = 0 THEN place END) AS p1, max(CASE WHEN k = 0 THEN new END) AS n1,
         max(CASE WHEN k = 1 THEN place END) AS p2, max(CASE WHEN k = 1 THEN new END) AS n2
  FROM replaced GROUP BY ALL),
swaps AS (
  SELECT t.prompt_id, t.turn, prompt, w, coalesce(removed, 0) AS removed, coalesce(swaps, 0) AS swaps,
         CASE WHEN len(w) < 3 THEN prompt ELSE array_to_string(list_transform(w, lambda x, i:
           CASE WHEN i - 1 = p2 THEN n2 WHEN i - 1 = p1 THEN n1 ELSE x END), ' ') END AS text
  FROM turns t LEFT JOIN pairs p ON t.prompt_id = p.prompt_id AND t.turn = p.turn
  WHERE slot = 'synonym')"""

# variants: prompt_id, pos, text; pos 0 is the prompt
VARIANTS = f"""{SWAPS},
bounds AS (
  SELECT prompt_id, turn, prompt, text,
         200.0 * (length(array_to_string(w, '')) - removed
           + len(regexp_extract_all({strip("prompt")}, '{SPACE_CLASS}* {SPACE_CLASS}*')))
           / (length(prompt) + length(text)) AS least,
         200.0 * least(length(prompt), length(text)) / (length(prompt) + length(text)) AS most
  FROM swaps),
admitted AS (
  SELECT prompt_id, turn, text FROM bounds
  WHERE CASE WHEN least >= {fv.SIMILARITY_FLOOR} OR text = prompt THEN TRUE
             WHEN most < {fv.SIMILARITY_FLOOR} THEN FALSE
             ELSE 200.0 * {lcs("prompt", "text")} / (length(prompt) + length(text)) >= {fv.SIMILARITY_FLOOR} END),
candidates AS (
  SELECT prompt_id, turn, ({PREFIXES})[{number("turn", "1", str(len(fv.WRAP_PREFIXES)))} + 1] || prompt AS text
  FROM turns, steps WHERE slot = 'wrap'
  UNION ALL
  SELECT prompt_id, turn, {strip_intent("prompt")} FROM turns WHERE slot = 'strip'
  UNION ALL
  SELECT prompt_id, turn, {typo("prompt", "place")}
  FROM (SELECT *, {number("turn", "1", "greatest(length(prompt) - 1, 1)")} AS place FROM turns, steps)
  WHERE slot = 'typo' AND length(prompt) >= 5
  UNION ALL
  SELECT prompt_id, turn, text FROM admitted),
firsts AS (
  SELECT c.prompt_id, c.text, min(c.turn) AS turn
  FROM candidates c JOIN prompts p ON c.prompt_id = p.prompt_id AND c.text <> p.prompt GROUP BY ALL),
variants AS (
  SELECT prompt_id, 0 AS pos, prompt AS text FROM prompts
  UNION ALL
  SELECT prompt_id, pos, text FROM (
    SELECT prompt_id, text, row_number() OVER (PARTITION BY prompt_id ORDER BY turn) AS pos FROM firsts)
  WHERE pos <= {fv.MUTATION_COUNT})"""

# cosines: prompt_id, pos, semantic_sim of every variant and its prompt
VARIANT_COSINES = f"""bags AS (SELECT prompt_id, pos, bucket, count(*) AS tf
  FROM (SELECT prompt_id, pos, unnest({bag("text")}) AS bucket FROM variants) GROUP BY ALL),
norms AS (SELECT prompt_id, pos, sqrt(sum(tf * tf)) AS norm FROM bags GROUP BY ALL),
dots AS (SELECT a.prompt_id, b.pos, sum(a.tf * b.tf) AS dot
  FROM bags a JOIN bags b ON a.prompt_id = b.prompt_id AND a.bucket = b.bucket WHERE a.pos = 0 GROUP BY ALL),
cosines AS (
  SELECT v.prompt_id, v.pos, coalesce(dot / (n.norm * o.norm), 0.0) AS semantic_sim
  FROM variants v LEFT JOIN dots d ON v.prompt_id = d.prompt_id AND v.pos = d.pos
  LEFT JOIN norms n ON v.prompt_id = n.prompt_id AND v.pos = n.pos
  LEFT JOIN norms o ON v.prompt_id = o.prompt_id AND o.pos = 0)"""


# -- scoring ----------------------------------------------------------------


def model_words(x: str) -> str:
    return (
        f"list_filter(string_split_regex(lower({x}), '[^\\p{{L}}\\p{{N}}]+'), lambda w: w <> '')"
    )


COEFFICIENTS = f"coefficients(word, weight) AS {values(list(tb.COEFFICIENTS.items()))}"


def risks(source: str, key: str) -> str:
    """risks: key columns and risk, that of the riskiest window, of the rows of a relation with a text."""
    return f"""{COEFFICIENTS},
word_lists AS (SELECT {key}, {model_words("text")} AS list FROM {source}),
occurrences AS (
  SELECT {key}, len(list) AS n, unnest(range(len(list))) AS place, unnest(list) AS word FROM word_lists),
window_sums AS (
  SELECT {key}, n, place, sum(coalesce(weight, 0)::DECIMAL(18,6)) OVER (
    PARTITION BY {key} ORDER BY place ROWS BETWEEN {fv.MODEL_TOKENS - 1} PRECEDING AND CURRENT ROW) AS margin
  FROM occurrences LEFT JOIN coefficients USING (word)),
margins AS (
  SELECT {key}, max(margin)::DOUBLE AS margin FROM window_sums
  WHERE place >= least(n, {fv.MODEL_TOKENS}) - 1 GROUP BY ALL),
risks AS (
  SELECT v.*, 1.0 / (1.0 + exp(-(coalesce(margin, 0.0) + {tb.INTERCEPT}))) AS risk
  FROM {source} v LEFT JOIN margins USING ({key}))"""


def consensus(source: str, key: str, extra: str = "3") -> str:
    """consensus: key, n, max_risk, raw of a relation with key and risk; extra is the word count."""
    return f"""ranked AS (
  SELECT {key}, risk, {extra} AS n_words, row_number() OVER (PARTITION BY {key} ORDER BY risk DESC) AS rank,
         count(*) OVER (PARTITION BY {key}) AS n
  FROM {source}),
consensus AS (
  SELECT {key}, any_value(n) AS n, max(risk) AS max_risk,
         (0.7::DOUBLE * max(risk)
           + 0.3::DOUBLE * avg(risk) FILTER (WHERE rank <= greatest(1, n // 2)))
           * CASE WHEN any_value(n_words) < 3 THEN 0.5::DOUBLE ELSE 1.0::DOUBLE END AS raw
  FROM ranked GROUP BY {key})"""


def band(x: str) -> str:
    return (
        f"CASE WHEN {x} < {fv.THRESHOLD_PASS}::DOUBLE THEN 'pass' "
        f"WHEN {x} < {fv.THRESHOLD_SANITIZE}::DOUBLE THEN 'sanitize' ELSE 'block' END"
    )


def rules(x: str, pairs) -> str:
    for pattern, replacement in pairs:
        x = f"regexp_replace({x}, {quote(pattern)}, {quote(replacement)}, 'gi')"
    return x
