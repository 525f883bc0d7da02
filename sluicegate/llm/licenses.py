"""Licence notices and licence expressions in texts.

*Words* are runs of digits, letters and all characters beyond ASCII, A-Z in lower case. One Aho-Corasick automaton
over a text's words finds notice phrases (``BASE``, ``PHRASES``) and identifier tags (``TAGS``) together, wherever
their words stand one after the other.

A tag that is followed by ``:`` or ``=`` opens an *expression* on the same line, such as
``(MIT OR Apache-2.0) AND GPL-2.0-only WITH Classpath-exception-2.0``. A shunting-yard parser brings it into
reverse Polish form (WITH binds before AND, AND before OR, parentheses first, any case) and a stack evaluates that:
its labels, and whether it can be kept to with permitted licences alone: OR needs one side, AND both, WITH its
licence, or an exception that is permitted in itself. An expression ends before the first token that can't follow;
an operator without a right side is left out and an open parenthesis closed, with ``complete`` false then.

The *score* is the chance that at least one label is right, if each is right by the weight of its best evidence.

Null texts count as empty: no words, nothing found, score 0. Repeated rows stay. Very long texts are rows like others:
memory per task is the automaton, 4 MB of texts (or one longer text) and its words. Empty tables give empty results.
Other columns may have any names; those of added columns give way. No row is moved.
"""

from __future__ import annotations

import re

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.types import (
    ArrayType,
    BooleanType,
    DoubleType,
    LongType,
    StringType,
    StructField,
    StructType,
)

from sluicegate.llm.common import annotate, once, sheltered, ship

# Phrases that are always looked for, and their labels.
BASE = (
    ("under the mit license", "mit"),
    ("apache license version 2", "apache-2"),
    ("cc by nc", "cc-by-nc"),
)
# Further notice phrases, their labels, and how far each one alone is a licence notice.
PHRASES = (
    ("mit license", "mit", 0.7),
    ("the mit licence", "mit", 0.7),
    ("permission is hereby granted free of charge to any person obtaining a copy", "mit", 0.9),
    ("apache license 2 0", "apache-2", 0.9),
    ("apache 2 0 license", "apache-2", 0.9),
    ("apache software license", "apache-2", 0.6),
    ("gnu general public license", "gpl", 0.8),
    ("gnu general public license version 2", "gpl-2", 0.95),
    ("gnu general public license version 3", "gpl-3", 0.95),
    ("gnu gpl", "gpl", 0.7),
    ("gplv2", "gpl-2", 0.8),
    ("gplv3", "gpl-3", 0.8),
    ("gnu lesser general public license", "lgpl", 0.9),
    ("gnu library general public license", "lgpl", 0.9),
    ("lgplv2 1", "lgpl", 0.8),
    ("lgplv3", "lgpl", 0.8),
    ("gnu affero general public license", "agpl-3", 0.9),
    ("agplv3", "agpl-3", 0.8),
    ("redistribution and use in source and binary forms", "bsd", 0.9),
    ("neither the name of the copyright holder nor the names of its contributors", "bsd-3-clause", 0.95),
    ("bsd 2 clause", "bsd-2-clause", 0.8),
    ("bsd 3 clause", "bsd-3-clause", 0.8),
    ("simplified bsd license", "bsd-2-clause", 0.9),
    ("new bsd license", "bsd-3-clause", 0.8),
    ("mozilla public license version 2 0", "mpl-2", 0.95),
    ("mozilla public license v 2 0", "mpl-2", 0.95),
    ("eclipse public license", "epl", 0.9),
    ("permission to use copy modify and or distribute this software for any purpose", "isc", 0.9),
    ("isc license", "isc", 0.8),
    ("boost software license", "bsl-1", 0.9),
    ("zlib license", "zlib", 0.8),
    ("artistic license", "artistic-2", 0.7),
    ("sil open font license", "ofl-1", 0.9),
    ("this is free and unencumbered software released into the public domain", "unlicense", 0.95),
    ("dedicated to the public domain", "public-domain", 0.8),
    ("creative commons attribution noncommercial", "cc-by-nc", 0.9),
    ("creative commons attribution non commercial", "cc-by-nc", 0.9),
    ("creative commons attribution sharealike", "cc-by-sa", 0.9),
    ("creative commons attribution share alike", "cc-by-sa", 0.9),
    ("creative commons attribution noderivatives", "cc-by-nd", 0.9),
    ("creative commons attribution 4 0", "cc-by", 0.9),
    ("creative commons attribution 3 0", "cc-by", 0.9),
    ("cc by nc sa", "cc-by-nc-sa", 0.9),
    ("cc by nc nd", "cc-by-nc-nd", 0.9),
    ("cc by sa", "cc-by-sa", 0.9),
    ("cc by nd", "cc-by-nd", 0.9),
    ("cc by 4 0", "cc-by", 0.9),
    ("cc by 3 0", "cc-by", 0.9),
    ("cc0 1 0", "cc0", 0.9),
    ("all rights reserved", "reserved", 0.4),
)
BASE_WEIGHT = 0.95
TAGS = ("spdx license identifier", "license identifier", "license expression", "license", "licence", "licenses")
EXPRESSION_WEIGHT = 0.98
# Identifiers of expressions, without "only", "or later" and "+", and their labels.
IDENTIFIERS = {
    "0bsd": "bsd", "afl-3.0": "afl-3", "agpl-3.0": "agpl-3", "apache-1.1": "apache-1", "apache-2.0": "apache-2",
    "artistic-2.0": "artistic-2", "bsd-2-clause": "bsd-2-clause", "bsd-3-clause": "bsd-3-clause",
    "bsl-1.0": "bsl-1", "cc0-1.0": "cc0", "cc-by-3.0": "cc-by", "cc-by-4.0": "cc-by", "cc-by-nc-3.0": "cc-by-nc",
    "cc-by-nc-4.0": "cc-by-nc", "cc-by-nc-nd-4.0": "cc-by-nc-nd", "cc-by-nc-sa-4.0": "cc-by-nc-sa",
    "cc-by-nd-4.0": "cc-by-nd", "cc-by-sa-3.0": "cc-by-sa", "cc-by-sa-4.0": "cc-by-sa", "cddl-1.0": "cddl-1",
    "epl-1.0": "epl", "epl-2.0": "epl", "eupl-1.2": "eupl-1", "gpl-1.0": "gpl", "gpl-2.0": "gpl-2",
    "gpl-3.0": "gpl-3", "isc": "isc", "lgpl-2.0": "lgpl", "lgpl-2.1": "lgpl", "lgpl-3.0": "lgpl", "mit": "mit",
    "mit-0": "mit", "mpl-1.1": "mpl-1", "mpl-2.0": "mpl-2", "ms-pl": "ms-pl", "ncsa": "ncsa", "ofl-1.1": "ofl-1",
    "postgresql": "postgresql", "psf-2.0": "psf-2", "python-2.0": "psf-2", "unlicense": "unlicense",
    "upl-1.0": "upl-1", "wtfpl": "wtfpl", "x11": "mit", "zlib": "zlib",
}
EXCEPTIONS = (
    "autoconf-exception-3.0", "bison-exception-2.2", "bootloader-exception", "classpath-exception-2.0",
    "gcc-exception-3.1", "linux-syscall-note", "llvm-exception", "openssl-exception",
)
# What is permitted unless a caller says otherwise.
PERMITTED = frozenset(
    "mit apache-1 apache-2 bsd bsd-2-clause bsd-3-clause bsl-1 cc-by cc0 isc mit ncsa postgresql psf-2 unlicense "
    "upl-1 zlib public-domain classpath-exception-2.0 gcc-exception-3.1 linux-syscall-note".split()
)
PRECEDENCE = {"or": 1, "and": 2, "with": 3}
SEPARATORS = bytes(
    b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b > 127 else 32 for b in range(256)
)
WORD = re.compile(rb"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
OPENS = re.compile(rb"[\"'*]{0,3}[ \t]{0,8}[:=][ \t]*[\"'\[]{0,2}[ \t]*")
TOKEN = re.compile(rb"[ \t]*([()]|[A-Za-z0-9][A-Za-z0-9.+-]*)")
VARIANT = re.compile(r"(-only|-or-later|\+)$")

NOTICE = StructType(
    [StructField("kind", StringType()), StructField("word", LongType()), StructField("label", StringType())]
)
EXPRESSION = StructType(
    [
        StructField("word", LongType()),
        StructField("expression", StringType()),
        StructField("labels", ArrayType(StringType())),
        StructField("permitted", BooleanType()),
        StructField("complete", BooleanType()),
    ]
)


def label_of(identifier: str) -> str | None:
    """The label of a licence identifier, None if it isn't one."""
    name = VARIANT.sub("", identifier.lower())
    return "licenseref" if name.startswith("licenseref-") else IDENTIFIERS.get(name)


def tokens_at(text: bytes, at: int):
    """Tokens of an expression from a place on, to the first character that can't be in one."""
    while match := TOKEN.match(text, at):
        yield match[1].decode()
        at = match.end()


def parse(tokens) -> tuple[list[str], bool]:
    """Reverse Polish form of an expression, and whether nothing was missing in it."""
    output: list[str] = []
    waiting: list[str] = []
    operand_next, complete = True, True
    for token in tokens:
        word = token.lower()
        after_with = bool(waiting) and waiting[-1] == "with" and operand_next
        if operand_next:
            if word == "(" and not after_with:
                waiting.append("(")
                continue
            if not (word in EXCEPTIONS if after_with else label_of(token)):
                break
            output.append(token)
            operand_next = False
        elif word == ")":
            if "(" not in waiting:
                break
            while waiting[-1] != "(":
                output.append(waiting.pop())
            waiting.pop()
        elif word in PRECEDENCE:
            # "with" takes a licence, not a group.
            if word == "with" and (not label_of(output[-1])):
                break
            while waiting and waiting[-1] != "(" and PRECEDENCE[waiting[-1]] >= PRECEDENCE[word]:
                output.append(waiting.pop())
            waiting.append(word)
            operand_next = True
        else:
            break
    while operand_next and waiting:
        # What needs a right side that didn't come.
        complete = False
        if waiting.pop() != "(":
            operand_next = False
    while waiting:
        operator = waiting.pop()
        if operator == "(":
            complete = False
        else:
            output.append(operator)
    return output, complete


def evaluate(output: list[str], permitted: frozenset[str]) -> tuple[str, list[str], bool]:
    """A reverse Polish form as text with the parentheses it needs, its labels, and whether it is permitted."""
    stack: list[tuple[str, int, bool]] = []  # text, precedence, permitted
    labels = set()
    for token in output:
        if token not in PRECEDENCE:
            label = label_of(token)
            labels.update([label] if label else [])
            stack.append((token, 4, (label or token.lower()) in permitted))
            continue
        (right, right_level, right_good), (left, left_level, left_good) = stack.pop(), stack.pop()
        level = PRECEDENCE[token]
        left = f"({left})" if left_level < level else left
        right = f"({right})" if right_level < level else right
        good = left_good and right_good if token == "and" else left_good or right_good
        stack.append((f"{left} {token.upper()} {right}", level, good))
    text, _, good = stack[0]
    return text, sorted(labels), good


class Scanner:
    """The automaton over words, and what is permitted."""

    def __init__(self, permitted: frozenset[str]):
        self.permitted = permitted
        self.weights = {}
        self.automaton = ahocorasick.Automaton()
        found: dict[str, list[tuple[str, str]]] = {}
        for phrase, label in BASE:
            found.setdefault(phrase, []).append(("base", label))
        for phrase, label, weight in PHRASES:
            found.setdefault(phrase, []).append(("phrase", label))
            self.weights[phrase] = weight
        for phrase in TAGS:
            found.setdefault(phrase, []).append(("tag", ""))
        for phrase, meanings in found.items():
            self.automaton.add_word(f" {phrase} ", (phrase, meanings))
        self.automaton.make_automaton()

    def scan(self, text: str | None) -> tuple[int, list[dict], list[dict], float]:
        """Words, notices, expressions and score of a text."""
        data = (text or "").encode()
        words = data.translate(SEPARATORS).split()
        # Of one character per byte; the phrases are ASCII.
        joined = f" {b' '.join(words).decode('latin-1')} "
        found = list(self.automaton.iter(joined))
        if not found:
            return len(words), [], [], 0.0
        spaces = np.flatnonzero(np.frombuffer(joined.encode("latin-1"), dtype=np.uint8) == 32)
        starts = np.searchsorted(spaces, [end - len(phrase) - 1 for end, (phrase, _) in found]).tolist()
        notices, tags = [], {}
        best: dict[str, float] = {}

        def add(kind: str, word: int, label: str, weight: float) -> None:
            notices.append({"kind": kind, "word": word, "label": label})
            best[label] = max(best.get(label, 0.0), weight)

        for (_, (phrase, meanings)), word in zip(found, starts):
            for kind, label in meanings:
                if kind == "tag":
                    last = word + phrase.count(" ")
                    tags[last] = min(word, tags.get(last, word))
                else:
                    add(kind, word, label, BASE_WEIGHT if kind == "base" else self.weights[phrase])
        expressions = self.expressions(data, tags) if tags else []
        for row in expressions:
            for label in row["labels"]:
                add("expression", row["word"], label, EXPRESSION_WEIGHT)
        notices.sort(key=lambda row: (row["word"], row["kind"], row["label"]))
        wrong = 1.0
        for label in sorted(best):
            wrong *= 1 - best[label]
        return len(words), notices, expressions, 1 - wrong

    def expressions(self, data: bytes, tags: dict[int, int]) -> list[dict]:
        """Expressions behind tags, which are given by their last and first word."""
        rows = []
        for number, word in enumerate(WORD.finditer(data)):
            if number not in tags:
                continue
            opened = OPENS.match(data, word.end())
            if not opened:
                continue
            output, complete = parse(tokens_at(data, opened.end()))
            if output:
                text, labels, good = evaluate(output, self.permitted)
                rows.append(
                    {"word": tags[number], "expression": text, "labels": labels, "permitted": good, "complete": complete}
                )
        return rows


def scan(
    docs: DataFrame,
    text: str = "text",
    keep: list[str] | None = None,
    permitted: frozenset[str] = PERMITTED,
) -> DataFrame:
    """Add n_words, notices (kind, word, label), expressions and score of a text column.

    ``kind`` is base, phrase or expression, ``word`` the number of the first word, from 0. ``permitted`` has
    labels, and exceptions that make any licence permitted.
    """
    allowed = frozenset(permitted)

    def start():
        scanner = once(("licenses", allowed), lambda: Scanner(allowed))

        def work(texts):
            rows = list(map(scanner.scan, texts))
            kinds = (pa.int64(), _arrow(NOTICE), _arrow(EXPRESSION), pa.float64())
            return [pa.array(column, kind) for column, kind in zip(zip(*rows), kinds)]

        return work

    fields = [
        StructField("n_words", LongType()),
        StructField("notices", ArrayType(NOTICE)),
        StructField("expressions", ArrayType(EXPRESSION)),
        StructField("score", DoubleType()),
    ]

    def work(frame: DataFrame, names: dict[str, str]) -> DataFrame:
        return annotate(frame, fields, start, names[text], [names[c] for c in (docs.columns if keep is None else keep)])

    return sheltered(docs, work, keep, (text,))


def _arrow(rows: StructType) -> pa.DataType:
    kinds = {"string": pa.string(), "bigint": pa.int64(), "boolean": pa.bool_(), "array<string>": pa.list_(pa.string())}
    return pa.list_(pa.struct([(field.name, kinds[field.dataType.simpleString()]) for field in rows]))


ship(__name__)
