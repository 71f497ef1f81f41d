"""Licence scan: Aho-Corasick finds notice phrases and identifier tags, a shunting-yard parser evaluates the tags' expressions.

A text is brought to lower-case words, and one automaton finds every phrase between word ends, overlapping
ones too. A second automaton finds identifier tags in the raw text; the rest of a tag's line is an
expression of identifiers, AND, OR, WITH and brackets. It is evaluated to its identifiers and to whether
some choice of its alternatives is permissive (OR: either side, AND: both, WITH: the exception decides for
a licence that isn't permissive by itself).

Defined results: a null, empty or wordless text has no words, no labels and score 0; a tag gives labels only
if the whole rest of its line, up to the end of a comment, is an expression of identifiers of which at least one is
of a known family or a LicenseRef; a full stop, comma or quote at its end doesn't count; repeated rows are scanned each; a null doc_id stays null; an empty table
gives no rows. Other columns are not read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from deliverix.llm.common import small_batches, table, text_bytes

#: Phrases whose places are counted, with their labels.
BASE = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}
#: Phrases that only add labels.
NOTICES = {
    "affero general public license": "agpl",
    "all rights reserved": "proprietary",
    "boost software license": "bsl",
    "bsd license": "bsd",
    "cc by": "cc",
    "cc0": "cc0",
    "common development and distribution license": "cddl",
    "creative commons": "cc",
    "eclipse public license": "epl",
    "isc license": "isc",
    "lesser general public license": "lgpl",
    "licensed under the apache license version 2 0": "apache",
    "mozilla public license": "mpl",
    "permission is hereby granted free of charge": "mit",
    "public domain": "public-domain",
    "redistribution and use in source and binary forms": "bsd",
}
#: Tags before an expression.
TAGS = ("spdx-license-identifier:", "license-expression:")
#: Heads of identifiers, their labels, and whether they are permissive.
FAMILIES = {
    "0bsd": ("bsd", True), "agpl": ("agpl", False), "apache": ("apache", True), "bsd": ("bsd", True), "bsl": ("bsl", True), "cc0": ("cc0", True),
    "cc-by-nc": ("cc", False), "cc-by-nd": ("cc", False), "cc-by-sa": ("cc", False), "cc-by": ("cc", True), "cddl": ("cddl", False), "epl": ("epl", False),
    "gpl": ("gpl", False), "isc": ("isc", True), "lgpl": ("lgpl", False), "mit": ("mit", True), "mpl": ("mpl", False), "unlicense": ("public-domain", True), "zlib": ("zlib", True),
}
#: Exceptions that let a work be linked freely.
LINKING = ("classpath-exception", "gcc-exception", "linking-exception", "bootloader-exception", "llvm-exception")

_WORDS = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
_TOKEN = re.compile(r"\s*([()]|[A-Za-z0-9][A-Za-z0-9.+:-]*)\s*")
_BINDS = {"or": 1, "and": 2, "with": 3}


@lru_cache(maxsize=1)
def automata() -> tuple[ahocorasick.Automaton, ahocorasick.Automaton]:
    """One for phrases in spaced words, one for tags in raw lower-case text."""
    phrases, tags = ahocorasick.Automaton(), ahocorasick.Automaton()
    for phrase, label in (NOTICES | BASE).items():
        phrases.add_word(f" {phrase} ", (len(phrase) + 2, label, phrase in BASE))
    for tag in TAGS:
        tags.add_word(tag, tag)
    phrases.make_automaton()
    tags.make_automaton()
    return phrases, tags


def family(identifier: str) -> tuple[str, bool]:
    """Label of an identifier and whether it is permissive; an unknown one is its own label and isn't."""
    name = identifier.lower().rstrip("+")
    head = known(name)
    return FAMILIES[head] if head else (name, False)


def known(name: str) -> str | None:
    """The longest head of a family that an identifier in lower case has."""
    return max((h for h in FAMILIES if name == h or name.startswith(f"{h}-")), key=len, default=None)


def tokens(expression: str) -> list[str] | None:
    """The brackets and words of an expression; None if anything else is in it."""
    out, at = [], 0
    while at < len(expression):
        m = _TOKEN.match(expression, at)
        if not m:
            return None
        out.append(m[1])
        at = m.end()
    return out


def postfix(expression: str) -> list[str] | None:
    """Reverse Polish form, by the shunting-yard method; None if it doesn't parse."""
    out: list[str] = []
    stack: list[str] = []
    wants_operand = True
    for token in tokens(expression) or []:
        word = token.lower()
        if word in _BINDS:
            if wants_operand:
                return None
            while stack and stack[-1] in _BINDS and _BINDS[stack[-1]] >= _BINDS[word]:
                out.append(stack.pop())
            stack.append(word)
            wants_operand = True
        elif token == "(":
            if not wants_operand:
                return None
            stack.append(token)
        elif token == ")":
            if wants_operand:
                return None
            while stack and stack[-1] != "(":
                out.append(stack.pop())
            if not stack:
                return None
            stack.pop()
        elif wants_operand:
            out.append(token)
            wants_operand = False
        else:
            return None  # words after the expression
    if wants_operand or "(" in stack:
        return None
    return out + stack[::-1]


def evaluate(expression: str) -> tuple[set[str], bool] | None:
    """Labels of an expression and whether it can be met permissively."""
    rpn = postfix(expression)
    if rpn is None or not any(known(x.lower().rstrip("+")) or x.lower().startswith("licenseref-") for x in rpn):
        return None
    stack: list[tuple[set[str], bool, str]] = []
    for token in rpn:
        if token not in _BINDS:
            label, free = family(token)
            stack.append(({label}, free, token.lower()))
            continue
        right, left = stack.pop(), stack.pop()
        if token == "with":
            stack.append((left[0], left[1] or right[2].startswith(LINKING), left[2]))
        else:
            free = left[1] or right[1] if token == "or" else left[1] and right[1]
            stack.append((left[0] | right[0], free, ""))
    return stack[0][0], stack[0][1]


def scan(text: bytes) -> tuple:
    """n_words, n_base, first_word, last_word, base_labels, labels, score, expressions, permissive of one text."""
    phrases, tags = automata()
    words = text.translate(_WORDS).split()
    spaced = (b" " + b" ".join(words) + b" ").decode("latin-1")
    ends: list[int] = []
    base: set[str] = set()
    labels: set[str] = set()
    places = 0
    for end, (size, label, counted) in phrases.iter(spaced):
        labels.add(label)
        places += 1
        if counted:
            base.add(label)
            ends.append(end - size + 1)
    first = spaced.count(" ", 0, min(ends)) if ends else None
    last = spaced.count(" ", 0, max(ends)) if ends else None
    expressions: list[str] = []
    free: list[bool] = []
    marks = [end + 1 for end, _ in tags.iter(text.translate(_LOWER).decode("latin-1"))]
    for at, after in zip(marks, [*marks[1:], len(text)]):
        stop = text.find(b"\n", at, after)
        line, *more = re.split(rb"[\r\n]|\*/|-->", text[at : after if stop < 0 else stop], maxsplit=1)
        if not more and stop < 0 and after < len(text):
            continue  # what has another tag in it is no expression, so no byte is looked at more than twice
        expression = line.decode("utf-8", "replace").strip().rstrip(".,;\"'` ")
        if found := evaluate(expression):
            labels |= found[0]
            free.append(found[1])
            expressions.append(expression)
    score = 1.0 if expressions else 1 - 0.5 ** min(places, 50)
    return len(words), len(ends), first, last, ",".join(sorted(base)), ",".join(sorted(labels)), score, expressions, all(free) if free else None


SCHEMA = (
    "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, "
    "expressions array<string>, permissive boolean"
)


def scan_documents(docs: DataFrame) -> DataFrame:
    """A row of findings for every row of docs(doc_id, text); see SCHEMA."""
    small_batches(docs.sparkSession)
    kinds = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.float64(), pa.list_(pa.string()), pa.bool_()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = list(zip(*map(scan, text_bytes(b.column(1))))) or [[]] * len(kinds)
            yield pa.RecordBatch.from_arrays(
                [b.column(0), *(pa.array(c, k) for c, k in zip(found, kinds))],
                names=["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "expressions", "permissive"],
            )

    return docs.select("doc_id", "text").mapInArrow(run, SCHEMA)


def op2_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_documents(table(spark, sf_dir, "documents"))
