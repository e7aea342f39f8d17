"""Personal data: identifiers found in the text as it stands and in a deobfuscated form of it, mapped back.

A chain of transducers rewrites a text and keeps, for every character of the
result, which stretch of the source it stands for:

1. homoglyphs: full-width and other compatibility forms, foreign digits and
   look-alike letters become the ASCII characters they imitate, dashes a hyphen,
   odd spaces a space; invisible characters vanish. A word of one foreign script
   is a word of that script and stays; only a word that mixes look-alikes with
   ASCII letters, digits or ``@`` is rewritten;
2. spelled digits: a row of at least ``LEAST_SPELLED`` spelled digits, in English,
   German, French or Spanish, becomes digits, and a ``plus`` before it a ``+``;
3. at and dot disguises: ``(at)``, ``[dot]`` and their like in any brackets, and the
   bare words where both occur in one address (``name at host dot net``), become
   ``@`` and ``.``; the blanks around them go.

Identifiers are detected in the source, which gives the base spans, and in the
rewritten text; spans of the latter go back through the map, and those that
overlap no base span of their kind are added. Where no transducer applies, a
text is not rewritten and has base spans only.

Detection starts at marks that every identifier has (``@``, ``+``, rows of digits)
and takes time in proportion to the text.

Offsets are code points, the end excluded. A null text is empty; a text without
identifiers has no spans. Repeated rows give repeated results, an empty table an
empty one; other columns are not read.
"""

from __future__ import annotations

import hashlib
import re
import unicodedata
from bisect import bisect_right
from collections.abc import Callable, Iterator
from functools import cache, partial

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from posthaste.llm.columns import by_place

KINDS = ("email", "ip", "card", "phone")
Span = tuple[int, int, str]

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
# Rows of digits are taken whole or not at all, so none is walked through twice.
_DOTTED = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++)+")
_DOT_DIGIT = re.compile(r"\.[0-9]")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_NAMED_HOST = re.compile(r"\.[A-Za-z]{2,}\Z")

# Letters of other scripts that look like ASCII letters.
LOOK_ALIKES = dict(zip(
    "АВЕКМНОРСТУХЅІЈаеорсухѕіјһԁԛԝ" "ΑΒΕΖΗΙΚΜΝΟΡΤΥΧαοινυρ",
    "ABEKMHOPCTYXSIJaeopcyxsijhdqw" "ABEZHIKMNOPTYXaoivup"))
INVISIBLE = frozenset("­​‌‍⁠﻿")
DASHES = frozenset("‐‑‒–—―−")
DOTS = frozenset("。｡․")
# Letters of the languages at hand imitate nothing.
_FOREIGN = re.compile(r"[^\x00-\x7fÀ-ÖØ-öø-ſ]")
_ALIKE = re.compile(f"[{''.join(LOOK_ALIKES)}]")
_WORD = re.compile(f"[A-Za-z0-9._%+@{''.join(LOOK_ALIKES)}-]+")
_ASCII_PART = re.compile(r"[A-Za-z0-9@]")

# The digits 0 to 9 in four languages.
DIGIT_WORDS = (
    "zero one two three four five six seven eight nine",
    "null eins zwei drei vier fünf sechs sieben acht neun",
    "zéro un deux trois quatre cinq six sept huit neuf",
    "cero uno dos tres cuatro cinco seis siete ocho nueve")
SPELLED = {word: str(digit) for line in DIGIT_WORDS for digit, word in enumerate(line.split())}
LEAST_SPELLED = 3
_AT, _DOT = "at|arroba|arobase", "dot|punkt|punto|point"
_ONE = "|".join(sorted(SPELLED, key=len, reverse=True))
_PART = rf"(?:(?:{_ONE})|[0-9]++)(?![^\W_])"
_SPELLED = re.compile(
    rf"(?<![^\W_])(?:(plus)[ -]+)?({_PART}(?:(?:[ ]+(?:{_DOT})[ ]+|[ ,-]+|\.){_PART})*+)", re.IGNORECASE)
_IN_SPELLED = re.compile(rf"({_ONE})(?![^\W_])|([0-9]+)|([ ]+(?:{_DOT})[ ]+|\.)|([ ,-]+)", re.IGNORECASE)
# What a lower-case text must have for the transducers to look closer: cheap to look for.
_TWO_SPELLED = re.compile(rf"(?:{_ONE})(?:[ ,.-]+|[ ]+(?:{_DOT})[ ]+)(?:{_ONE})")
_ENCLOSED = re.compile(rf"[(\[{{<][ ]*(?:{_AT}|@|{_DOT}|\.)[ ]*[)\]}}>]|&(?:\#64|\#x40|commat|\#46|\#x2e|period);")
_BARE_DOTS = [f" {word} " for word in _DOT.split("|")]
_SIGN = re.compile(
    rf"[(\[{{<][ ]*(?:(?P<wrapped_at>{_AT}|@)|(?P<wrapped_dot>{_DOT}|\.))[ ]*[)\]}}>]"
    r"|(?P<coded_at>&(?:\#64|\#x40|commat);)|(?P<coded_dot>&(?:\#46|\#x2e|period);)"
    rf"|(?<=[A-Za-z0-9)\]}}>])[ ]+(?:(?P<bare_at>{_AT})|(?P<bare_dot>{_DOT}))[ ]+(?=[A-Za-z0-9(\[{{<])", re.IGNORECASE)
_LABELS = re.compile(r"[A-Za-z0-9._%+-]+")
_AFTER_AT = re.compile(r"@[A-Za-z0-9.-]+\Z")
# Longest host name.
_HOST = 255
# Last labels that an address of bare words must have.
ENDINGS = frozenset("com net org edu gov mil int info biz name io dev app ai co me tv eu uk us ca au nz ie de at ch fr be nl lu "
                    "es pt it pl cz se no dk fi ru ua jp cn kr in br mx ar cl test example invalid".split())


# --- detection ---------------------------------------------------------------

def luhn(digits: str) -> bool:
    total = 0
    for place, digit in enumerate(reversed(digits)):
        value = int(digit) * (1 + place % 2)
        total += value - 9 * (value > 9)
    return total % 10 == 0


def _emails(text: str) -> Iterator[tuple[int, int]]:
    reached, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > reached and text[start - 1] in _LOCAL:
            start -= 1
        found = _DOMAIN.match(text, at + 1) if start < at else None
        if found:
            yield start, found.end()
        # Letters before this sign are part of no later match.
        reached = found.end() if found else at + 1
        at = text.find("@", reached)


def _addresses(text: str) -> Iterator[tuple[int, int]]:
    if not _DOT_DIGIT.search(text):
        return
    for chain in _DOTTED.finditer(text):
        start, parts = chain.start(), chain[0].split(".")
        for first in range(0, len(parts) - 3, 4):
            four = parts[first:first + 4]
            end = start + sum(map(len, four)) + 3
            if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or "0") <= 255 for p in four):
                yield start, end
            start = end + 1


def _cards(text: str) -> Iterator[tuple[int, int]]:
    for found in _CARD.finditer(text):
        if found.end() - found.start() >= 12:
            digits = found[0].replace(" ", "").replace("-", "")
            if 12 <= len(digits) <= 19 and luhn(digits):
                yield found.span()


def _phones(text: str) -> Iterator[tuple[int, int]]:
    for found in _PHONE.finditer(text):
        if 9 <= sum(map(str.isdigit, found[0])) <= 15:
            yield found.span()


DETECTORS: dict[str, Callable[[str], Iterator[tuple[int, int]]]] = {
    "email": _emails, "ip": _addresses, "card": _cards, "phone": _phones}


def detect(text: str) -> list[Span]:
    """Identifiers of a text as it stands, by start and then kind as listed."""
    spans = [(start, end, kind) for kind in KINDS for start, end in DETECTORS[kind](text)]
    return sorted(spans, key=lambda s: (s[0], KINDS.index(s[2])))


# --- transducers ---------------------------------------------------------------

class Tape:
    """A rewritten text and, piece by piece, what it stands for in the source.

    Pieces are (start in the text, start in the source, source length); within a
    piece that was copied characters go one to one, a rewritten piece stands
    for its stretch as a whole.
    """

    def __init__(self, text: str):
        self.text = text
        self.starts, self.origins, self.ends, self.copied = [0], [0], [len(text)], [True]

    def rewrite(self, edits: list[tuple[int, int, str]]) -> Tape:
        """Replace stretches (start, end, by) of the text, which are in order and do not overlap."""
        if not edits:
            return self
        made = Tape.__new__(Tape)
        made.starts, made.origins, made.ends, made.copied = [], [], [], []
        parts: list[str] = []
        size = upto = 0

        def keep(start: int, end: int) -> None:
            nonlocal size
            while start < end:
                piece = bisect_right(self.starts, start) - 1
                limit = self.starts[piece + 1] if piece + 1 < len(self.starts) else len(self.text)
                stop = min(end, limit)
                source, last = self.source(start, stop)
                made.starts.append(size)
                made.origins.append(source)
                made.ends.append(last)
                made.copied.append(self.copied[piece])
                parts.append(self.text[start:stop])
                size += stop - start
                start = stop

        for start, end, by in edits:
            keep(upto, start)
            if by:
                source, last = self.source(start, end)
                made.starts.append(size)
                made.origins.append(source)
                made.ends.append(last)
                made.copied.append(False)
                parts.append(by)
                size += len(by)
            upto = end
        keep(upto, len(self.text))
        made.text = "".join(parts)
        if not made.starts:
            made.starts, made.origins, made.ends, made.copied = [0], [0], [0], [True]
        return made

    def source(self, start: int, end: int) -> tuple[int, int]:
        """The stretch of the source that a non-empty stretch of the text stands for."""
        first = bisect_right(self.starts, start) - 1
        last = bisect_right(self.starts, end - 1) - 1
        begin = self.origins[first] + (start - self.starts[first] if self.copied[first] else 0)
        stop = self.origins[last] + end - self.starts[last] if self.copied[last] else self.ends[last]
        return begin, stop


@cache
def _imitated(char: str) -> str | None:
    """What a character becomes if it is no plain one: other text, nothing, or None to stay."""
    if char in INVISIBLE:
        return ""
    if char in DASHES:
        return "-"
    if char in DOTS:
        return "."
    if char.isdecimal():
        return str(unicodedata.decimal(char))
    plain = unicodedata.normalize("NFKC", char)
    return plain if plain != char and plain.isascii() else None


def _homoglyphs(tape: Tape) -> Tape:
    if tape.text.isascii() or not _FOREIGN.search(tape.text):
        return tape
    signs = ((f.start(), f.end(), _imitated(f[0])) for f in _FOREIGN.finditer(tape.text))
    tape = tape.rewrite([s for s in signs if s[2] is not None])
    edits = []
    if _ALIKE.search(tape.text):
        for word in _WORD.finditer(tape.text):
            if not word[0].isascii() and _ASCII_PART.search(word[0]):
                edits += [(i, i + 1, LOOK_ALIKES[c]) for i, c in enumerate(word[0], word.start()) if c in LOOK_ALIKES]
    return tape.rewrite(edits)


def _spelled_digits(tape: Tape) -> Tape:
    if not _TWO_SPELLED.search(tape.text.lower()):
        return tape
    edits = []
    for row in _SPELLED.finditer(tape.text):
        parts = list(_IN_SPELLED.finditer(tape.text, row.start(2), row.end(2)))
        if sum(p[1] is not None for p in parts) < LEAST_SPELLED:
            continue
        if row[1]:
            edits.append((row.start(1), row.start(2), "+"))
        for part in parts:
            if part[1]:
                edits.append((part.start(), part.end(), SPELLED[part[1].lower()]))
            elif not part[2]:
                edits.append((part.start(), part.end(), "." if part[3] else ""))
    return tape.rewrite(edits)


def _disguises(tape: Tape) -> Tape:
    lower = tape.text.lower()
    if not _ENCLOSED.search(lower) and not any(dot in lower for dot in _BARE_DOTS):
        return tape
    edits = []
    run: list[re.Match] = []
    for sign in _SIGN.finditer(tape.text):
        # Signs belong to one address if nothing but a name or host label stands between them.
        if run and not _LABELS.fullmatch(tape.text, *_between(tape.text, run[-1].end(), sign.start())):
            edits += _address(tape.text, run)
            run = []
        run.append(sign)
    return tape.rewrite(edits + _address(tape.text, run) if run else edits)


def _between(text: str, start: int, end: int) -> tuple[int, int]:
    """The stretch without the blanks at its ends."""
    while start < end and text[start] == " ":
        start += 1
    while end > start and text[end - 1] == " ":
        end -= 1
    return start, end


def _ending(text: str, sign: re.Match) -> str:
    """The last host label after a sign, in lower case."""
    found = _LABELS.match(text, _between(text, sign.end(), len(text))[0])
    return found[0].rstrip(".").rpartition(".")[2].lower() if found else ""


def _address(text: str, run: list[re.Match]) -> list[tuple[int, int, str]]:
    """What the signs of one address become. Bare words count only where an at is followed by a disguised dot."""
    kinds = ["@" if sign["wrapped_at"] or sign["coded_at"] or sign["bare_at"] else "." for sign in run]
    bare = [bool(sign["bare_at"] or sign["bare_dot"]) for sign in run]
    # An at in the source itself may stand before the first sign.
    plain = _AFTER_AT.search(text[max(0, run[0].start() - _HOST):run[0].start()])
    ats = [i for i, kind in enumerate(kinds) if kind == "@"]
    counted = {i for i in range(len(run)) if not bare[i]}
    if plain and _ending(text, run[ats[0] - 1 if ats else -1]) in ENDINGS:
        counted |= set(range(ats[0] if ats else len(run)))
    for nth, at in enumerate(ats):
        last = ats[nth + 1] if nth + 1 < len(ats) else len(run)
        if last > at + 1 and (not any(bare[at + 1:last]) or _ending(text, run[last - 1]) in ENDINGS):
            # With the dots of the name before the first at.
            counted |= set(range(at if nth else 0, last))
    edits = []
    upto = 0
    for i, sign in enumerate(run):
        if i in counted:
            start, end = sign.span()
            while start > upto and text[start - 1] == " ":
                start -= 1
            while end < len(text) and text[end] == " ":
                end += 1
            edits.append((start, end, kinds[i]))
            upto = end
    return edits


TRANSDUCERS: tuple[Callable[[Tape], Tape], ...] = (_homoglyphs, _spelled_digits, _disguises)


def deobfuscated(text: str) -> Tape:
    tape = Tape(text)
    for step in TRANSDUCERS:
        tape = step(tape)
    return tape


# --- results --------------------------------------------------------------------

def find_personal(text: str) -> tuple[list[Span], list[Span]]:
    """Base spans and all spans, each by start and then kind as listed."""
    base = detect(text)
    tape = deobfuscated(text)
    if tape.text == text:
        return base, base
    taken = {kind: [s[:2] for s in base if s[2] == kind] for kind in KINDS}
    added = []
    for start, end, kind in detect(tape.text):
        begin, stop = tape.source(start, end)
        shown = tape.text[start:end]
        if shown == text[begin:stop] or (kind == "email" and not _NAMED_HOST.search(shown)):
            continue
        before = bisect_right(taken[kind], (stop,)) - 1
        if before < 0 or taken[kind][before][1] <= begin:
            added.append((begin, stop, kind))
    return base, sorted(base + added, key=_order)


def _order(span: Span) -> tuple[int, int, int]:
    return span[0], KINDS.index(span[2]), span[1]


def _listed(spans: list[Span]) -> str:
    return ",".join(f"{kind}:{start}:{end}" for start, end, kind in spans)


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = [find_personal(text.as_py() or "") for text in batch.column("text")]
        counts = [pa.array([sum(s[2] == kind for s in base) for base, _ in found], pa.int64()) for kind in KINDS]
        yield pa.record_batch(
            [batch.column("doc_id"), *counts,
             pa.array([hashlib.sha256(_listed(base).encode()).hexdigest() for base, _ in found], pa.string()),
             pa.array([_listed(spans) for _, spans in found], pa.string())],
            ["doc_id", *[f"n_{kind}" for kind in KINDS], "base_sha256", "spans"])


def scan(docs: DataFrame) -> DataFrame:
    """``docs(doc_id, text)`` -> counts of base spans by kind, a digest of them, and all spans; one row per row."""
    placed, [doc_id, text] = by_place(docs, "doc_id", "text")
    rows = placed.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    return rows.mapInArrow(
        _scan, "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string")


def masked(text: str, mark: str = "<{kind}>") -> str:
    """The text with every identifier, disguised ones too, replaced by ``mark``; overlapping ones by one mark."""
    parts, upto = [], 0
    for start, end, kind in find_personal(text)[1]:
        if start >= upto:
            parts += [text[upto:start], mark.format(kind=kind)]
        upto = max(upto, end)
    return "".join([*parts, text[upto:]])


def _masked(batches: Iterator[pa.RecordBatch], place: int, mark: str) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = [None if t is None else masked(t, mark) for t in batch.column(place).to_pylist()]
        yield batch.set_column(place, batch.schema.field(place), pa.array(texts, batch.schema.field(place).type))


def mask(docs: DataFrame, mark: str = "<{kind}>") -> DataFrame:
    """``docs`` with the identifiers in ``text`` replaced; other columns and null texts stay."""
    placed, [text] = by_place(docs, "text")
    return placed.mapInArrow(partial(_masked, place=int(text[1:]), mark=mark), placed.schema).toDF(*docs.columns)
