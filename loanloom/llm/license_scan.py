"""Licence scans: notice phrases and identifier tags by Aho-Corasick, licence expressions by the shunting-yard method.

A text is read twice by automata: its words (lower-cased, one space apart) for notice phrases, and the text itself for
tags such as ``SPDX-License-Identifier:``.  What follows a tag is parsed as an expression of identifiers with ``or``,
``and``, ``with`` and parentheses, and evaluated: ``or`` leaves the choice of the milder side, ``and`` binds to both,
``with`` relaxes.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import ahocorasick
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The phrases of the contract, and their labels.
BASE = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}
#: Further notice phrases (lower-cased words) and their labels.
NOTICES = {
    "apache license": "apache",
    "mit license": "mit",
    "permission is hereby granted free of charge": "mit",
    "bsd license": "bsd",
    "redistribution and use in source and binary forms": "bsd",
    "mozilla public license": "mpl",
    "lesser general public license": "lgpl",
    "affero general public license": "agpl",
    "creative commons attribution": "cc-by",
    "cc by nc": "cc-by-nc",
    "cc by sa": "cc-by-sa",
    "cc0": "public-domain",
    "dedicated to the public domain": "public-domain",
}
#: How much a licence holds back, from 0 (nothing) to 1 (all).
GRADES = {
    "public-domain": 0.1, "mit": 0.2, "bsd": 0.2, "apache": 0.2, "cc-by": 0.3, "cc-by-sa": 0.5, "mpl": 0.5, "lgpl": 0.6,
    "gpl": 0.7, "agpl": 0.8, "cc-by-nc": 0.9, "reserved": 1.0, "other": 0.5,
}
#: What stands before a licence expression, in lower case.
TAGS = ("spdx-license-identifier:", "license-expression:")
#: Families of identifiers by their first letters, the longer ones first.
FAMILIES = (
    ("cc-by-nc", "cc-by-nc"), ("cc-by-sa", "cc-by-sa"), ("cc-by", "cc-by"), ("cc0", "public-domain"), ("unlicense", "public-domain"),
    ("agpl", "agpl"), ("lgpl", "lgpl"), ("gpl", "gpl"), ("mpl", "mpl"), ("apache", "apache"), ("mit", "mit"), ("bsd", "bsd"), ("licenseref-proprietary", "reserved"),
)

_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
_WORDS = bytes(_LOWER[b] if b >= 128 or chr(b).isalnum() else 32 for b in range(256))
_TOKEN = re.compile(r"[ \t]*(?:([()])|([A-Za-z0-9][A-Za-z0-9.+:\-]*))")
_BINDS = {"or": 1, "and": 2, "with": 3}
_RELAXED = 0.75


def words_of(text: str) -> list[bytes]:
    """Words: runs of letters, digits and non-ASCII characters, with A-Z in lower case."""
    return text.encode().translate(_WORDS).split()


def _family(identifier: str) -> str:
    name = identifier.lower()
    return next((label for start, label in FAMILIES if name.startswith(start)), "other")


def postfix(tokens: list[str]) -> list[str] | None:
    """Shunting-yard: infix to postfix; the operators bind ``with`` before ``and`` before ``or``.  None if malformed."""
    out, held, operand = [], [], True  # operand: whether one must come next
    for token in tokens:
        binds = _BINDS.get(token.lower())
        if token == "(" and operand:
            held.append(token)
        elif token == ")" and not operand:
            while held and held[-1] != "(":
                out.append(held.pop())
            if not held:
                return None
            held.pop()
        elif binds and not operand:
            while held and held[-1] != "(" and _BINDS[held[-1]] >= binds:
                out.append(held.pop())
            held.append(token.lower())
            operand = True
        elif token not in "()" and not binds and operand:
            out.append(token)
            operand = False
        else:
            return None
    if operand or "(" in held:
        return None
    return out + held[::-1]


def evaluate(expression: list[str]) -> tuple[float, list[str]] | None:
    """Grade and labels of a licence expression, given as tokens; None if malformed."""
    order = postfix(expression)
    if order is None:
        return None
    stack: list[tuple[float, frozenset[str]]] = []
    for token in order:
        if token in _BINDS:
            (right, b), (left, a) = stack.pop(), stack.pop()
            if token == "with":  # the right side names an exception, not a licence
                stack.append((left * _RELAXED, a))
            else:
                stack.append((min(left, right) if token == "or" else max(left, right), a | b))
        else:
            stack.append((GRADES[_family(token)], frozenset((_family(token),))))
    return stack[0][0], sorted(stack[0][1])


def expression_at(text: str, start: int) -> tuple[str, float, list[str]] | None:
    """The longest well-formed expression from ``start`` to the end of its line."""
    end = text.find("\n", start)
    line, tokens, ends, at = text[start : len(text) if end < 0 else end], [], [], 0
    while token := _TOKEN.match(line, at):
        tokens.append(token[1] or token[2])
        at = token.end()
        ends.append(at)
    for n in range(len(tokens), 0, -1):
        if found := evaluate(tokens[:n]):
            return line[: ends[n - 1]].strip(), *found
    return None


@lru_cache(maxsize=1)
def _automata() -> tuple:
    notices, tags = ahocorasick.Automaton(), ahocorasick.Automaton()
    for phrase, label in (BASE | NOTICES).items():
        notices.add_word(f" {phrase} ", (f" {phrase} ", label, phrase in BASE))
    for tag in TAGS:
        tags.add_word(tag, tag)
    notices.make_automaton()
    tags.make_automaton()
    return notices, tags


def scan_text(text: str) -> tuple[int, list[tuple[int, str, bool]], list[tuple[str, float, list[str]]]]:
    """Count of words; the notices as (first word, label, whether a base phrase); the expressions with grade and labels."""
    notices, tags = _automata()
    words = words_of(text)
    line = f" {b' '.join(words).decode()} "
    found, place, word = [], 0, 0
    for start, label, base in sorted((end + 1 - len(phrase), label, base) for end, (phrase, label, base) in notices.iter(line)):
        word += line.count(" ", place, start)
        place = start
        found.append((word, label, base))
    lowered = text.encode().translate(_LOWER).decode()
    expressions = [expression_at(text, end + 1) for end, _ in tags.iter(lowered)]
    return len(words), found, [e for e in expressions if e]


SCANNED = "n_words long, notices array<struct<word:long,label:string,base:boolean>>, expressions array<struct<text:string,grade:double,labels:array<string>>>"


def scan(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of ``docs``: the key, ``n_words``, ``notices`` and ``expressions`` (see ``SCANNED``), in text order.

    Null and empty texts have no words and no finds; malformed expressions count as far as they are well-formed;
    repeated rows and null keys give a row each; other columns are left out; an empty table gives an empty table.
    """
    notice = pa.struct([("word", pa.int64()), ("label", pa.string()), ("base", pa.bool_())])
    expression = pa.struct([("text", pa.string()), ("grade", pa.float64()), ("labels", pa.list_(pa.string()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            scanned = [scan_text(t or "") for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    pa.array([n for n, _, _ in scanned], pa.int64()),
                    pa.array([[dict(zip(("word", "label", "base"), x, strict=True)) for x in found] for _, found, _ in scanned], pa.list_(notice)),
                    pa.array([[dict(zip(("text", "grade", "labels"), x, strict=True)) for x in found] for _, _, found in scanned], pa.list_(expression)),
                ],
                [key, "n_words", "notices", "expressions"],
            )

    kind = docs.schema[key].dataType.simpleString()
    return docs.select(F.col(key), F.col(text)).mapInArrow(run, f"`{key}` {kind}, {SCANNED}")


def _labels(labels: Column) -> Column:
    return F.array_join(F.array_sort(F.array_distinct(labels)), ",")


def summarize(scanned: DataFrame, key: str = "doc_id") -> DataFrame:
    """Per document: count, first and last place and labels of the base phrases, all labels, and ``score``: the highest
    grade of any notice or expression found, 0 without any."""
    notices, expressions = F.col("notices"), F.col("expressions")
    base = F.filter(notices, lambda n: n["base"])
    grades = F.create_map(*(F.lit(x) for pair in GRADES.items() for x in pair))
    every = F.concat(F.transform(notices, lambda n: grades[n["label"]]), F.transform(expressions, lambda e: e["grade"]))
    return scanned.select(
        key,
        "n_words",
        F.size(base).cast("long").alias("n_base"),
        F.array_min(F.transform(base, lambda n: n["word"])).alias("first_word"),
        F.array_max(F.transform(base, lambda n: n["word"])).alias("last_word"),
        _labels(F.transform(base, lambda n: n["label"])).alias("base_labels"),
        _labels(F.concat(F.transform(notices, lambda n: n["label"]), F.flatten(F.transform(expressions, lambda e: e["labels"])))).alias("labels"),
        F.coalesce(F.array_max(every), F.lit(0.0)).alias("score"),
        F.transform(expressions, lambda e: e["text"]).alias("expressions"),
    )
