"""Licence scans: Aho-Corasick for notices and tags, shunting-yard for licence expressions.

Texts are brought to words with one space between them, so that a phrase is
found however it is punctuated. One automaton holds all notice phrases and the
words of the ``SPDX-License-Identifier`` tag. Behind a tag, the licence
expression is read from the text as written, turned into postfix order by the
shunting-yard method, and evaluated.

Words are runs of letters a-z, digits and characters beyond ASCII; only A-Z are
lower-cased. Nulls and ties: a null or empty text has no words, no labels and
score 0. An expression that cannot be read gives the labels up to the fault.
Repeated rows give repeated results, an empty table an empty one; other
columns are not read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import cache

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame

from posthaste.llm.words import as_bytes

# The base phrases and their labels.
BASE = {
    "under the mit license": "mit",
    "apache license version 2": "apache-2",
    "cc by nc": "cc-by-nc",
}
# Notices that are searched besides, and their labels.
MORE = {
    "gnu general public license": "gpl",
    "gnu lesser general public license": "lgpl",
    "gnu affero general public license": "agpl",
    "mozilla public license": "mpl",
    "redistribution and use in source and binary forms": "bsd",
    "isc license": "isc",
    "eclipse public license": "epl",
    "released into the public domain": "public-domain",
    "cc0 1 0 universal": "cc0",
    "cc by sa": "cc-by-sa",
    "cc by 4 0": "cc-by",
    "all rights reserved": "all-rights-reserved",
}
TAG = "spdx license identifier"
# How freely a text under a label can be used: 1 freely, 0 not at all. Matched by the longest beginning.
FREEDOM = {
    "mit": 1.0, "apache": 1.0, "bsd": 1.0, "isc": 1.0, "cc0": 1.0, "public-domain": 1.0, "unlicense": 1.0,
    "zlib": 1.0, "cc-by": 0.9, "mpl": 0.6, "epl": 0.6, "lgpl": 0.6, "cc-by-sa": 0.5, "gpl": 0.3,
    "agpl": 0.2, "cc-by-nc": 0.1, "cc-by-nd": 0.1, "all-rights-reserved": 0.0,
}
UNKNOWN = 0.2

_WORD = bytearray(256)
for _b in range(256):
    _WORD[_b] = _b if _b >= 128 or chr(_b).isdigit() or chr(_b).islower() else 32
    if 65 <= _b <= 90:
        _WORD[_b] = _b + 32
_NORMAL = bytes(_WORD)
_TAG = re.compile(rb"(?i)(?<![a-z0-9\x80-\xff])spdx[^a-z0-9\x80-\xff]+license[^a-z0-9\x80-\xff]+identifier[ \t:]*"
                  rb"([a-z0-9.+() \t-]*)")
_TOKEN = re.compile(r"[()]|[A-Za-z0-9.+-]+")
_RANK = {"or": 1, "and": 2, "with": 3}


def postfix(expression: str) -> list[str]:
    """A licence expression in postfix order, by the shunting-yard method.

    WITH binds closer than AND, and AND closer than OR. Reading ends where two
    names follow each other or brackets do not match, as prose begins there.
    """
    output: list[str] = []
    waiting: list[str] = []
    name_next = True
    for token in _TOKEN.findall(expression):
        low = token.lower()
        if low in _RANK:
            if name_next:
                break
            while waiting and waiting[-1] != "(" and _RANK[waiting[-1]] >= _RANK[low]:
                output.append(waiting.pop())
            waiting.append(low)
            name_next = True
        elif token == "(":
            if not name_next:
                break
            waiting.append(token)
        elif token == ")":
            if name_next or "(" not in waiting:
                break
            while waiting[-1] != "(":
                output.append(waiting.pop())
            waiting.pop()
        else:
            if not name_next:
                break
            output.append(low)
            name_next = False
    if name_next and waiting:
        # The last operator has no right side.
        while waiting and waiting[-1] in _RANK:
            waiting.pop()
            break
    output.extend(x for x in reversed(waiting) if x != "(")
    return output


def freedom(label: str) -> float:
    fitting = [x for x in FREEDOM if label.startswith(x)]
    return FREEDOM[max(fitting, key=len)] if fitting else UNKNOWN


def evaluate(tokens: list[str]) -> tuple[float | None, set[str]]:
    """How freely the expression allows use, and the licences it names.

    OR leaves the choice, so the freer side counts; AND binds to both, so the
    stricter does; WITH adds an exception to its left side.
    """
    held: list[tuple[float, set[str]]] = []
    for token in tokens:
        if token not in _RANK:
            held.append((freedom(token), {token}))
            continue
        if len(held) < 2:
            break
        right, left = held.pop(), held.pop()
        if token == "with":
            held.append((min(1.0, left[0] + 0.1), left[1]))
        else:
            held.append(((max if token == "or" else min)(left[0], right[0]), left[1] | right[1]))
    if not held:
        return None, set()
    return min(x[0] for x in held), set().union(*(x[1] for x in held))


@cache
def _automaton() -> ahocorasick.Automaton:
    found = ahocorasick.Automaton()
    for phrase in [*BASE, *MORE, TAG]:
        found.add_word(f" {phrase} ", phrase)
    found.make_automaton()
    return found


def scan_text(raw: bytes) -> tuple:
    """One row of :func:`scan` for the UTF-8 bytes of a text, without its id."""
    listed = raw.translate(_NORMAL).split()
    joined = f" {b' '.join(listed).decode('latin-1')} "
    base, extra, scores, places, tags = set(), set(), [], [], False
    blanks = upto = 0
    for end, phrase in _automaton().iter(joined):
        if phrase in BASE:
            # Blanks are counted from the last hit on; each word of the phrase has one before it.
            blanks, upto = blanks + joined.count(" ", upto, end), end
            places.append(blanks - phrase.count(" ") - 1)
            base.add(BASE[phrase])
            scores.append(freedom(BASE[phrase]))
        elif phrase == TAG:
            tags = True
        else:
            extra.add(MORE[phrase])
            scores.append(freedom(MORE[phrase]))
    if tags:
        for said in _TAG.findall(raw):
            score, names = evaluate(postfix(said.decode("ascii")))
            if score is not None:
                extra |= names
                scores.append(score)
    return (len(listed), len(places), min(places, default=None), max(places, default=None),
            ",".join(sorted(base)), ",".join(sorted(base | extra)), min(scores, default=0.0))


_COLUMNS = {"n_words": pa.int64(), "n_base": pa.int64(), "first_word": pa.int64(), "last_word": pa.int64(),
            "base_labels": pa.string(), "labels": pa.string(), "score": pa.float64()}


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = [scan_text(text) for text in as_bytes(batch.column("text"))]
        columns = [pa.array([r[i] for r in rows], kind) for i, kind in enumerate(_COLUMNS.values())]
        yield pa.record_batch([batch.column("doc_id"), *columns], ["doc_id", *_COLUMNS])


def scan(docs: DataFrame) -> DataFrame:
    """``docs(doc_id, text)`` -> per document ``n_words``, places and labels of the
    base phrases, all labels, and ``score``: how freely the strictest of all that
    was found allows use, 0 where nothing was."""
    return docs.selectExpr("cast(doc_id as long) as doc_id", "text").mapInArrow(
        _scan, "doc_id long, n_words long, n_base long, first_word long, last_word long, "
               "base_labels string, labels string, score double")
