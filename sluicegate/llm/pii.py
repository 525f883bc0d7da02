"""Personal data replaced by keyed surrogates of the same type and form.

One pattern finds e-mail addresses, IP addresses, card and account numbers, phone numbers, social security
numbers, IBANs and names after a title. Each different entity of the corpus gets a surrogate drawn from a hash of
the secret key, its type and its normal form:

- digits become digits and letters letters of their script, in the same places; a phone keeps its country code,
  a card its first digit and its being valid or not by the check digit, an IBAN its country and validity;
- given names keep gender (from the title) and script, family names (the last of up to 16 parts) their script:
  Latin, Cyrillic or Greek, all others get Latin ones. Names are found by their capitals, so not in scripts without;
- initials follow a keyed order of their alphabet, so different ones stay different;
- words of these names that stand elsewhere in the same text, with a capital and without a title, get the same
  surrogates, also where such a word means something else. They don't count as mentions;
- case and separators of each mention stay: spellings of one entity get spellings of one surrogate
  (coreference), across all texts.

*Collision checks* keep entities distinct. A surrogate must be no entity found in the corpus and no other
entity's surrogate; of two entities that draw the same one, the smaller keeps it and the other draws again. Rounds
go on until none is left; after ``SAME_SIZE_ROUNDS`` rounds, when a form is used up, surrogates get longer.

Everything is Spark SQL. Texts are cut at their mentions and put together again in their own row; what moves are
mentions of different texts, different entities and, for texts with mentions, the text once; rows of a text that
very many rows have don't move at all. An entity that a third of the rows have collapses before it moves.

Null and empty texts stay as they are. Repeated rows stay; empty tables give empty results. Very long texts are rows
like others: no pattern takes more than a bounded step back or down. Other columns may have any names; one called as
the number of mentions gives way. Surrogates depend on the key and on which entities the corpus has, not on
partitions or order.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sluicegate.llm.common import join_hot, sheltered
from sluicegate.session import stored

SAME_SIZE_ROUNDS = 8
# Titles before names, with the gender they tell.
TITLES = {
    "f": ("Mrs", "Ms", "Miss", "Frau", "Mme", "Madame", "Señora", "Sra", "Госпожа"),
    "m": ("Mr", "Herr", "Monsieur", "Señor", "Sr", "Господин"),
    "n": ("Dr", "Prof"),
}
# Syllables that names are made of, and how given names of a gender end.
SYLLABLES = {
    "latin": ("ba", "del", "fi", "gor", "ha", "jen", "ka", "lin", "mo", "nar", "ol", "pe", "ras", "sim", "tu", "vel"),
    "cyrillic": ("ба", "дел", "фи", "гор", "жа", "зин", "ка", "лин", "мо", "нар", "ол", "пе", "рас", "сим", "ту", "вел"),
    "greek": ("βα", "δελ", "φι", "γορ", "χα", "ζεν", "κα", "λιν", "μο", "ναρ", "ολ", "πε", "ρασ", "σιμ", "του", "βελ"),
}
ENDINGS = {
    "latin": {"f": "a", "m": "o", "n": "en", "s": "er"},
    "cyrillic": {"f": "а", "m": "й", "n": "ен", "s": "ов"},
    "greek": {"f": "α", "m": "ος", "n": "ι", "s": "ιδης"},
}
LATIN_LOWER = "abcdefghijklmnopqrstuvwxyz"
CYRILLIC_LOWER = "абвгдежзиклмнопрстуфхцчшэюя"
GREEK_LOWER = "αβγδεζηθικλμνξοπρστυφχψω"

_TITLE = "|".join(title for titles in TITLES.values() for title in titles)
# A word of a name: capitals, apostrophes and hyphens inside, but no possessive s and no title.
_NAME_WORD = (
    rf"(?!(?:{_TITLE})(?!\p{{L}}))\p{{Lu}}(?=\p{{L}}|['’]\p{{Lu}})[\p{{L}}\p{{M}}]*+"
    r"(?:(?:['’](?!s(?!\p{L}))|-(?=\p{Lu}))\p{L}[\p{L}\p{M}]*+){0,5}"
)
_INITIALS = r"\p{Lu}(?:\.\p{Lu}){0,5}+\.?"
# Every alternative starts where its kind of run starts and takes bounded or possessive steps: linear in the text.
# No group repeats without a bound, because Java's matcher descends once per repetition; a domain has 127 labels at most.
PATTERNS = {
    "email": r"(?<![\p{L}\p{N}._%+-])[\p{L}\p{N}._%+-]++@(?:[A-Za-z0-9-]++\.){1,126}[A-Za-z]{2,}",
    "iban": r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:[A-Z0-9]{11,30}"
    r"|(?: [A-Z0-9]{4}){2}(?:(?: [A-Z0-9]{4}){1,5}(?: [A-Z0-9]{1,3})?| [A-Z0-9]{3})(?<=[0-9][A-Z]{0,3}))(?![A-Za-z0-9])",
    "ip": r"(?<![0-9.])(?:(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[1-9]?[0-9])\.){3}"
    r"(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[1-9]?[0-9])(?![0-9]|\.[0-9])",
    "card": r"(?<![0-9])(?:[0-9]{13,19}|[0-9]{4}(?:[ -][0-9]{4}){3}|[0-9]{4}[ -][0-9]{6}[ -][0-9]{5})(?![0-9])",
    "ssn": r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])",
    "phone": r"(?<![0-9+])(?:\+[0-9](?:\)?[ .-]?\(?[0-9]){4,18}\)?"
    r"|\(?[0-9]{3}\)?[ .-][0-9]{3}[ .-][0-9]{4})(?![0-9])",
    "name": rf"(?<![\p{{L}}])(?:{_TITLE})\.? (?:(?:{_NAME_WORD}|{_INITIALS}) ){{0,15}}{_NAME_WORD}",
}
ANY = "|".join(f"(?:{pattern})" for pattern in PATTERNS.values())


def holds_any(text: Column) -> Column:
    """Whether a text has a mention; most texts have no digit, @ or title, which is quickly seen."""
    quick = text.rlike("[0-9@]")
    for titles in TITLES.values():
        for title in titles:
            quick = quick | text.contains(title)
    return F.coalesce(quick & text.rlike(ANY), F.lit(False))


def _kind(mention: Column) -> Column:
    result = F.lit("name")
    for kind, pattern in reversed(list(PATTERNS.items())):
        if kind != "name":
            result = F.when(mention.rlike(rf"^(?:{pattern})$"), F.lit(kind)).otherwise(result)
    return result


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def _script(value: Column) -> Column:
    return F.when(value.rlike(r"\p{IsCyrillic}"), "cyrillic").when(value.rlike(r"\p{IsGreek}"), "greek").otherwise("latin")


def _normal(kind: Column, mention: Column) -> Column:
    """One form for all spellings of an entity that isn't a name."""
    digits = _digits(mention)
    phone = F.when((F.length(digits) == 11) & digits.startswith("1"), F.substring(digits, 2, 10)).otherwise(digits)
    return (
        F.when(kind == "phone", phone)
        .when(kind.isin("card", "ssn"), digits)
        .when(kind == "iban", F.replace(mention, F.lit(" "), F.lit("")))
        .otherwise(F.lower(mention))
    )


def _draw(seed: Column, place: Column, size: int) -> Column:
    return F.pmod(F.xxhash64(seed, place), F.lit(size)).cast("int")


def _pick(alphabet: str, number: Column) -> Column:
    return F.call_function("substring", F.lit(alphabet), number + 1, F.lit(1))


def _masked(text: Column, seed: Column, kept: Column) -> Column:
    """Each character after the first ``kept`` ones replaced by one of its class."""
    characters = F.split(text, "")

    def one(char: Column, place: Column) -> Column:
        return (
            F.when(place < kept, char)
            .when(char.rlike("[0-9]"), _pick("0123456789", _draw(seed, place, 10)))
            .when(char.rlike(r"\p{Lu}"), F.upper(_letter(char, seed, place)))
            .when(char.rlike(r"\p{L}"), _letter(char, seed, place))
            .otherwise(char)
        )

    return F.array_join(F.transform(characters, one), "")


def _letter(char: Column, seed: Column, place: Column) -> Column:
    return (
        F.when(char.rlike(r"\p{IsCyrillic}"), _pick(CYRILLIC_LOWER, _draw(seed, place, len(CYRILLIC_LOWER))))
        .when(char.rlike(r"\p{IsGreek}"), _pick(GREEK_LOWER, _draw(seed, place, len(GREEK_LOWER))))
        .otherwise(_pick(LATIN_LOWER, _draw(seed, place, 26)))
    )


def _luhn(digits: Column) -> Column:
    """The sum of a number's digits as check digits are computed, modulo 10; 0 if the number is valid."""
    reversed_digits = F.split(F.reverse(digits), "")

    def value(char: Column, place: Column) -> Column:
        digit = char.cast("int")
        doubled = F.when(digit > 4, 2 * digit - 9).otherwise(2 * digit)
        return F.when(place % 2 == 1, doubled).otherwise(digit)

    return F.aggregate(F.transform(reversed_digits, value), F.lit(0), lambda a, x: a + x) % 10


def _card(normal: Column, seed: Column) -> Column:
    """Another number of the same length and first digit, valid if and only if the number was."""
    size = F.length(normal)
    body = F.call_function("substring", _masked(normal, seed, F.lit(1)), F.lit(1), size - 1)
    right = F.pmod(F.lit(10) - _luhn(F.concat(body, F.lit("0"))), F.lit(10))
    shift = F.when(_luhn(normal) == 0, F.lit(0)).otherwise(1 + _draw(seed, F.lit(-1), 9))
    return F.concat(body, F.pmod(right + shift, F.lit(10)).cast("string"))


def _mod97(text: Column) -> Column:
    """A text of digits and capitals as the number that account check digits are computed from, modulo 97."""

    def step(rest: Column, char: Column) -> Column:
        letter = F.when(char.rlike("[A-Z]"), (100 * rest + F.ascii(char) - 55) % 97)
        return letter.otherwise((10 * rest + F.coalesce(F.try_to_number(char, F.lit("9")).cast("int"), F.lit(0))) % 97)

    return F.aggregate(F.split(text, ""), F.lit(0), step)


def _iban(normal: Column, seed: Column) -> Column:
    """Another account of the same country and form, with valid check digits if and only if the account had them."""
    country, body = F.substring(normal, 1, 2), F.call_function("substring", normal, F.lit(5), F.length(normal))
    new = _masked(body, seed, F.lit(0))
    right = 98 - _mod97(F.concat(new, country, F.lit("00")))
    was_right = _mod97(F.concat(body, F.substring(normal, 1, 4))) == 1
    shift = F.when(was_right, F.lit(0)).otherwise(1 + _draw(seed, F.lit(-1), 96))
    digits = F.lpad((2 + (right - 2 + shift) % 97).cast("string"), 2, "0")
    return F.concat(country, digits, new)


def _initials(word: Column, secret: str) -> Column:
    """Initials with every letter replaced by the next one in a keyed order of its alphabet.

    Different initials stay different, everywhere and for one name alike. Letters outside the alphabets are drawn.
    """
    letters, new = "", ""
    for alphabet in (LATIN_LOWER, CYRILLIC_LOWER, GREEK_LOWER):
        order = sorted(alphabet.upper(), key=lambda x: hashlib.sha256(f"{secret}\x1finitial\x1f{x}".encode()).digest())
        letters += "".join(order)
        new += "".join(order[1:] + order[:1])
    seed = F.sha2(F.concat_ws("\x1f", F.lit(secret), F.lit("initials"), word).cast("binary"), 256)
    drawn = F.split(_masked(word, seed, F.lit(0)), "")

    def one(char: Column, place: Column) -> Column:
        known = F.translate(char, letters, "") == ""
        return F.when(known, F.translate(char, letters, new)).otherwise(F.get(drawn, place))

    return F.array_join(F.transform(F.split(word, ""), one), "")


def _ip(seed: Column) -> Column:
    return F.concat_ws(".", *[(1 + _draw(seed, F.lit(i), 254)).cast("string") for i in range(4)])


def _email(normal: Column, seed: Column) -> Column:
    """Another address with the same top-level domain."""
    ending = F.regexp_extract(normal, r"(\.[a-z]+)$", 1)
    rest = F.call_function("substring", normal, F.lit(1), F.length(normal) - F.length(ending))
    return F.concat(_masked(rest, seed, F.lit(0)), ending)


def _syllable(syllables: tuple[str, ...], seed: Column):
    return lambda place: F.get(F.lit(list(syllables)), _draw(seed, place, len(syllables)))


def _name(kind: Column, seed: Column, attempt: Column) -> Column:
    """Syllables of the script, one more for every fourth attempt, and the ending of the gender."""
    script, sort = F.element_at(F.split(kind, ":"), 3), F.element_at(F.split(kind, ":"), 2)
    number = F.lit(3) + F.floor(attempt / 4).cast("int")
    result = F.lit("")
    for name, syllables in SYLLABLES.items():
        made = F.array_join(F.transform(F.sequence(F.lit(0), number), _syllable(syllables, seed)), "")
        ending = F.lit("")
        for key, value in ENDINGS[name].items():
            ending = F.when(sort == key, F.lit(value)).otherwise(ending)
        result = F.when(script == name, F.concat(made, ending)).otherwise(result)
    return result


def _surrogate(secret: str, attempt: int) -> Column:
    """A candidate for an entity (kind, normal)."""
    words = [F.lit(secret), F.col("kind"), F.col("normal"), F.lit(str(attempt))]
    seed = F.sha2(F.concat_ws("\x1f", *words).cast("binary"), 256)
    kind, normal = F.col("kind"), F.col("normal")
    country = F.greatest(F.length(normal) - 10, F.lit(0))
    made = (
        F.when(kind == "email", _email(normal, seed))
        .when(kind == "ip", _ip(seed))
        .when(kind == "card", _card(normal, seed))
        .when(kind == "phone", _masked(normal, seed, country))
        .when(kind == "iban", _iban(normal, seed))
        .when(kind == "ssn", _masked(normal, seed, F.lit(0)))
        .otherwise(_name(kind, seed, F.lit(attempt)))
    )
    longer = attempt - SAME_SIZE_ROUNDS
    if longer < 0:
        return made
    digit = F.when(kind.startswith("name"), F.lit("")).otherwise(
        F.array_join(F.transform(F.sequence(F.lit(0), F.lit(longer)), lambda i: _draw(seed, 1000 + i, 10)), "")
    )
    return (
        F.when(kind == "email", F.concat(digit, made))
        .when(kind == "ip", F.concat(made, F.lit(":"), digit))  # a port: the address itself stays one
        .otherwise(F.concat(made, digit))
    )


def assign(entities: DataFrame, secret: str) -> DataFrame:
    """kind, normal, surrogate of different entities (kind, normal): distinct, and none of the entities.

    ``entities`` should be stored; each round is.
    """
    waiting, result, attempt = entities, None, 0
    originals = entities.select("kind", F.col("normal").alias("surrogate"))
    while True:
        drawn = waiting.select("kind", "normal", _surrogate(secret, attempt).alias("surrogate"))
        free = drawn.join(originals, ["kind", "surrogate"], "left_anti")
        if result is not None:
            free = free.join(result.select("kind", "surrogate"), ["kind", "surrogate"], "left_anti")
        won = free.groupBy("kind", "surrogate").agg(F.min("normal").alias("normal"))
        won = stored(won.select("kind", "normal", "surrogate"), "surrogates")
        result = won if result is None else result.unionByName(won)
        waiting = stored(waiting.join(won.select("kind", "normal"), ["kind", "normal"], "left_anti"), "waiting")
        if waiting.isEmpty():
            return result
        attempt += 1


def _fill(mention: Column, digits: Column) -> Column:
    """A mention with its last digits replaced, in place; digits too many go to its end."""
    spare = F.length(_digits(mention)) - F.length(digits)

    def one(char: Column, place: Column) -> Column:
        before = F.length(_digits(F.call_function("substring", mention, F.lit(1), place)))
        number = before - spare
        new = F.call_function("substring", digits, number + 1, F.lit(1))
        return F.when(char.rlike("[0-9]") & (number >= 0), new).otherwise(char)

    filled = F.array_join(F.transform(F.split(mention, ""), one), "")
    extra = F.call_function("substring", digits, F.length(digits) + spare + 1, F.greatest(-spare, F.lit(0)))
    return F.when(spare < 0, F.concat(_fill_equal(mention, digits), extra)).otherwise(filled)


def _fill_equal(mention: Column, digits: Column) -> Column:
    """A mention with all its digits replaced by the first digits."""

    def one(char: Column, place: Column) -> Column:
        before = F.length(_digits(F.call_function("substring", mention, F.lit(1), place)))
        new = F.call_function("substring", digits, before + 1, F.lit(1))
        return F.when(char.rlike("[0-9]"), new).otherwise(char)

    return F.array_join(F.transform(F.split(mention, ""), one), "")


def _like(mention: Column, value: Column) -> Column:
    """A value in lower case with capitals where the mention has them."""
    shape = F.split(mention, "")

    def one(char: Column, place: Column) -> Column:
        return F.when(F.get(shape, place).rlike(r"\p{Lu}"), F.upper(char)).otherwise(char)

    return F.array_join(F.transform(F.split(value, ""), one), "")


def mentions_of(docs: DataFrame, text: str = "text") -> DataFrame:
    """text_key, place, mention, kind and normal forms of every mention of every different text."""
    source = F.col(f"`{text}`")
    found = docs.filter(holds_any(source)).select(
        F.sha2(source.cast("binary"), 256).alias("text_key"),
        F.regexp_extract_all(source, F.lit(ANY), F.lit(0)).alias("mentions"),
    )
    once_each = found.groupBy("text_key").agg(F.first("mentions").alias("mentions"), F.count("*").alias("rows"))
    rows = once_each.select("text_key", "rows", F.posexplode("mentions").alias("place", "mention"))
    rows = rows.withColumn("form", _kind(F.col("mention")))
    words = F.split(F.col("mention"), " ")
    title = F.regexp_replace(F.get(words, F.lit(0)), r"\.$", "")
    gender = F.lit("n")
    for name, titles in TITLES.items():
        gender = F.when(title.isin(*titles), F.lit(name)).otherwise(gender)
    is_name = F.col("form") == "name"
    parts = F.when(is_name, F.slice(words, F.lit(2), F.size(words))).otherwise(F.array("mention"))
    rows = rows.select(
        "text_key", "rows", "place", "mention", "form", gender.alias("gender"), F.size(parts).alias("parts"),
        F.posexplode(parts).alias("part", "word"),
    )
    word = F.lower(F.replace("word", F.lit("’"), F.lit("'")))
    sort = F.when(F.col("part") + 1 == F.col("parts"), "s").otherwise(F.col("gender"))
    initials = is_name & F.col("word").rlike(rf"^{_INITIALS}$")
    return rows.select(
        "text_key",
        "rows",
        "place",
        "part",
        "mention",
        "form",
        "word",
        F.when(initials, F.lit("initials"))
        .when(is_name, F.concat(F.lit("name:"), sort, F.lit(":"), _script(word)))
        .otherwise(F.col("form"))
        .alias("kind"),
        F.when(is_name, word).otherwise(_normal(F.col("form"), F.col("mention"))).alias("normal"),
    )


def _again(gap: Column, words: Column) -> Column:
    """Text between mentions, with the name words of the same text's mentions replaced (lower case, surrogate)."""
    pattern = F.lit(rf"(?<![\p{{L}}\p{{M}}]){_NAME_WORD}")

    def one(word: Column) -> Column:
        plain = F.lower(F.replace(word, F.lit("’"), F.lit("'")))
        new = F.get(F.filter(words, lambda x: x["normal"] == plain), F.lit(0))["surrogate"]
        return F.coalesce(F.when(F.upper(word) == word, F.upper(new)).otherwise(F.initcap(new)), word)

    found = F.transform(F.regexp_extract_all(gap, pattern, F.lit(0)), one)
    between = F.call_function("split", gap, pattern, F.lit(-1))
    return F.array_join(F.zip_with(between, F.array_append(found, F.lit("")), lambda a, b: F.concat(a, b)), "")


def replace(docs: DataFrame, secret: str, text: str = "text", counts: str | None = None) -> DataFrame:
    """The rows with surrogates in the text column and, if named, a column with the number of mentions."""

    def work(frame: DataFrame, names: dict[str, str]) -> DataFrame:
        return _replace(frame, secret, names[text], counts)

    return sheltered(docs, work)


def _replace(docs: DataFrame, secret: str, text: str, counts: str | None) -> DataFrame:
    mentions = stored(mentions_of(docs, text), "mentions")
    every = mentions.filter("kind <> 'initials'").select("kind", "normal")
    chosen = stored(assign(stored(every.distinct(), "entities"), secret), "surrogates")
    mention, word, value = F.col("mention"), F.col("word"), F.col("surrogate")
    is_name = F.col("form") == "name"
    written = (
        F.when(F.col("kind") == "initials", _initials(word, secret))
        .when(is_name, F.when(F.upper(word) == word, F.upper(value)).otherwise(F.initcap(value)))
        .when(F.col("form").isin("phone", "card", "ssn"), _fill(mention, value))
        .when(F.col("form") == "email", _like(mention, value))
        .when((F.col("form") == "iban") & mention.contains(" "), F.regexp_replace(value, "(.{4})(?=.)", "$1 "))
        .otherwise(value)
    )
    known = F.when(is_name & value.isNotNull(), F.struct("normal", "surrogate"))
    whole_mention = F.array_join(F.transform(F.array_sort("new"), lambda x: x["written"]), " ")
    title = F.when(is_name, F.concat(F.get(F.split(mention, " "), F.lit(0)), F.lit(" "))).otherwise("")
    replaced = (
        mentions.join(chosen, ["kind", "normal"], "left")
        .select(
            "text_key", "rows", "place", "part", title.alias("title"), written.alias("written"), known.alias("known")
        )
        .groupBy("text_key", "place")
        .agg(
            F.first("rows").alias("rows"),
            F.first("title").alias("title"),
            F.collect_list(F.struct("part", "written")).alias("new"),
            F.collect_set("known").alias("known"),
        )
        .select("text_key", "rows", "place", F.concat("title", whole_mention).alias("written"), "known")
        .groupBy("text_key")
        .agg(
            F.first("rows").alias("rows of the text"),
            F.array_sort(F.collect_list(F.struct("place", "written"))).alias("new"),
            F.array_sort(F.array_distinct(F.flatten(F.collect_list("known")))).alias("name words"),
        )
        .select(
            "text_key", "rows of the text", F.transform("new", lambda x: x["written"]).alias("new parts"), "name words"
        )
    )
    replaced = stored(replaced, "replaced")
    names = [c for c in docs.columns if counts is None or c.lower() != counts.lower()]
    source = F.col(f"`{text}`")
    has = holds_any(source)
    plain = docs.filter(~has).select(*[f"`{c}`" for c in names])
    touched = docs.filter(has).withColumn("key of the text", F.sha2(source.cast("binary"), 256))
    found = replaced.withColumnRenamed("text_key", "key of the text")
    joined = join_hot(touched, found, "key of the text", "rows of the text")
    gaps = F.split(source, ANY, -1)
    named = F.transform(gaps, lambda gap: _again(gap, F.col("name words")))
    gaps = F.when(F.size("name words") > 0, named).otherwise(gaps)
    whole = F.array_join(
        F.zip_with(gaps, F.array_append("new parts", F.lit("")), lambda a, b: F.concat(a, b)), ""
    )
    fresh = joined.select(
        *[whole.alias(c) if c == text else F.col(f"`{c}`") for c in names],
        *([F.size("new parts").alias(counts)] if counts else []),
    )
    if counts:
        plain = plain.withColumn(counts, F.lit(0))
    return plain.unionByName(fresh)
