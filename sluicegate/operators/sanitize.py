"""Rule-based rewriting of prompts, all of it as column expressions."""

from __future__ import annotations

import string
from collections.abc import Callable
from functools import reduce
from operator import or_

from pyspark.sql import Column
from pyspark.sql import functions as F

from sluicegate import fixed_values as fv
from sluicegate.functions import text as tx

# Rules as (pattern, replacement), applied in order, case ignored. They use nothing that differs
# between regex dialects. A clause ends with its sentence or line.
CLAUSE = r"[^.!?\n]*[.!?]?"
PERSONA_RULES = (
    (r"(you are now|pretend (to be|you are)|roleplay as|assume you are|imagine you are)" + CLAUSE, ""),
    (r"(and )?act as (a|an)? ?" + CLAUSE, ""),
    (r"(write|in) (a )?fictional story (where|in which|about)?" + r"[^.!?:\n]*[.!?:]?", ""),
)
META_RULES = (
    (r"ignore (all )?(of )?(the )?(previous|prior|above) (instructions|directions|prompts|context|rules)" + CLAUSE, ""),
    (r"(reveal|show|print|repeat|tell me) (me )?(your|the) (system |hidden )?(prompt|instructions)" + CLAUSE, ""),
    (r"system override:?", ""),
    (r"developer mode:? ?(enabled|on)?", ""),
    (r"do (not|n't) refuse", ""),
    (r"hypothetically( speaking)?,?", ""),
    (r"(from now on|in (your|the) next (message|reply|turn)|for the rest of this conversation)" + CLAUSE, ""),
)
FORMAT_RULES = (
    (r"<[/!?]?[a-z][^<>]*>", " "),
    (r"```[a-z]*", " "),
    (r"#{2,}", " "),
    (r"-{3,}", " "),
    (r"\*{2,}|_{2,}|~{2,}|%{3,}", " "),
    (r"[{}\[\]]", " "),
    (r"// todo:[^\n]*\n#", " "),
)
# A run of escapes is one blank. It is found escape by escape: the first becomes the blank, those that follow
# another one go. A pattern that repeats the alternation would descend once per escape, without a bound.
ESCAPE = r"(?:\\u[0-9a-f]{4}|\\x[0-9a-f]{2})"
ENCODED_RULES = (
    (rf"(?<={ESCAPE}){ESCAPE}", ""),
    (ESCAPE, " "),
    (r"[a-z0-9+/]{40,}={0,2}", " "),
    (r"(0x)?[0-9a-f]{32,}", " "),
)
FILTER_ATTACK = (
    r"(reveal|show|print|ignore|change|modify|bypass|disable|override)[^.!?\n]{0,40}"
    r"(system prompt|safety filter|system instruction|these rules|your (rules|instructions|filter))"
)
HARM_LIMIT = 0.8
# What a request that the lexicon rates harmful is replaced by.
TOPIC_TEXT = "Request for information about general safety"
PUNCTUATION = string.punctuation + "‘’“”«»…–—"
# Every match of a group of rules holds one of its needles, in lower case. Looking for them is
# far cheaper than trying the patterns, and most texts hold none.
PERSONA_NEEDLES = ("you are", "pretend to be", "roleplay as", "act as", "fictional story")
META_NEEDLES = (
    "ignore ", "prompt", "instructions", "system override", "developer mode", "do not refuse",
    "do n't refuse", "hypothetically", "from now on", " next ", "for the rest of this conversation",
)
FORMAT_NEEDLES = ("<", "```", "##", "---", "**", "__", "~~", "%%%", "{", "}", "[", "]", "// todo:")
ENCODED_NEEDLES = ("\\u", "\\x")
LONG_RUN = "[a-zA-Z0-9+/]{32}"
ATTACK_NEEDLES = ("system prompt", "safety filter", "system instruction", "these rules", "your ")


def holds_any(text: Column, needles: tuple[str, ...]) -> Column:
    return tx.let(
        F.lower(text), lambda low: reduce(or_, [low.contains(F.lit(needle)) for needle in needles])
    )


def apply_rules(
    text: Column, rules: tuple[tuple[str, str], ...], needed: Callable[[Column], Column]
) -> Column:
    """Apply rules in order to the texts that need them."""

    def rewritten(value: Column) -> Column:
        result = value
        for pattern, replacement in rules:
            result = F.regexp_replace(result, f"(?i){pattern}", replacement)
        return F.when(needed(value), result).otherwise(value)

    return tx.let(text, rewritten)


def remove_persona(text: Column) -> Column:
    return apply_rules(text, PERSONA_RULES, lambda t: holds_any(t, PERSONA_NEEDLES))


def remove_meta(text: Column) -> Column:
    return apply_rules(text, META_RULES, lambda t: holds_any(t, META_NEEDLES))


def remove_format(text: Column) -> Column:
    return apply_rules(text, FORMAT_RULES, lambda t: holds_any(t, FORMAT_NEEDLES))


def remove_encoded(text: Column) -> Column:
    return apply_rules(
        text, ENCODED_RULES, lambda t: t.rlike(LONG_RUN) | holds_any(t, ENCODED_NEEDLES)
    )


def bare(text: Column) -> Column:
    return F.translate(F.lower(text), PUNCTUATION, "")


def remove_profanity(text: Column, profanity: list[str]) -> Column:
    """Drop the words of a short list, whatever punctuation they carry; the rest keeps its order."""
    listed = F.array(*map(F.lit, profanity)) if profanity else F.array().cast("array<string>")
    return F.array_join(
        F.filter(
            tx.words(text),
            lambda word: ~F.array_contains(listed, bare(word)),
        ),
        " ",
    )


def cap_words(text: Column, limit: int = fv.SANITIZER_MAX_WORDS) -> Column:
    """At most so many words: the length of the result is part of the protocol."""
    return F.array_join(tx.first_words(text, limit), " ")


def attacks_filter(text: Column) -> Column:
    return holds_any(text, ATTACK_NEEDLES) & text.rlike(f"(?i){FILTER_ATTACK}")


def replace_attack(text: Column) -> Column:
    return F.when(attacks_filter(text), F.lit(fv.SANITIZER_GENERIC_TEXT)).otherwise(text)


def replace_harmful(text: Column, harm: Column, limit: float = HARM_LIMIT) -> Column:
    return F.when(harm >= limit, F.lit(TOPIC_TEXT)).otherwise(text)


def rewrite(text: Column, profanity: list[str]) -> Column:
    cleaned = remove_meta(remove_persona(remove_format(remove_encoded(text))))

    def shorten(value: Column) -> Column:
        found = holds_any(bare(value), tuple(profanity)) if profanity else F.lit(False)
        return cap_words(F.when(found, remove_profanity(value, profanity)).otherwise(value))

    return tx.strip(tx.let(cleaned, shorten))


def sanitize(text: Column, profanity: list[str], harm: Column | None = None) -> Column:
    """The whole protocol: attacks on the filter and harmful requests get a fixed text, anything
    else keeps its cleaned core; what cannot be rewritten becomes the failure text."""
    result = F.when(attacks_filter(text), F.lit(fv.SANITIZER_GENERIC_TEXT))
    if harm is not None:
        result = result.when(harm >= HARM_LIMIT, F.lit(TOPIC_TEXT))
    return F.coalesce(
        result.otherwise(rewrite(text, profanity)), F.lit(fv.SANITIZER_FAILURE_TEXT)
    )
