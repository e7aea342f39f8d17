"""Secret scans: Aho-Corasick for keywords, anchored expressions at the hits, checksums inside tokens.

An automaton finds all places where a keyword of a rule stands; only there is
the rule's expression tried, anchored, so the matches are the leftmost ones
that do not overlap. Long runs of hexadecimal digits have no keyword; they are
found by looking at every 32nd byte, one of which any long run must cover.

Tokens of the service kinds end in a checksum of what stands before; only those
where it is right count.

Offsets are code points, the end excluded. A null text is empty; a text without
secrets has no spans. Repeated rows give repeated results, an empty table an
empty one; other columns are not read.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections.abc import Callable, Iterator
from functools import cache

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from posthaste.llm.words import as_bytes

_BASE62 = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"
HEX_RUN = 32


def base62(number: int, width: int) -> str:
    digits = ""
    for _ in range(width):
        number, rest = divmod(number, 62)
        digits = _BASE62[rest] + digits
    return digits


def _crc_tail(found: re.Match) -> bool:
    """The last six characters are the CRC-32 of the random part, in base 62."""
    return base62(zlib.crc32(found[1]), 6) == found[2].decode("ascii")


def _luhn(found: re.Match) -> bool:
    """The last digit makes the weighted sum of all a multiple of ten."""
    digits = [int(d) for d in found[0].decode("ascii") if d.isdigit()]
    doubled = [sum(divmod(2 * d, 10)) for d in digits[-2::-2]]
    return len(digits) == 16 and (sum(digits[-1::-2]) + sum(doubled)) % 10 == 0


# kind: keywords in lower case, the anchored expression, and what a match must fulfil.
RULES: dict[str, tuple[tuple[str, ...], re.Pattern, Callable[[re.Match], bool]]] = {
    "assign": (
        ("password", "passwd", "secret", "token", "apikey", "api_key"),
        re.compile(rb"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""),
        lambda found: len(found[1]) >= 8),
    "access": (("akia",), re.compile(rb"AKIA[A-Z0-9]+"), lambda found: len(found[0]) >= 16),
    "github": (("ghp_", "gho_", "ghu_", "ghs_", "ghr_"),
               re.compile(rb"gh[pousr]_([A-Za-z0-9]{30})([A-Za-z0-9]{6})(?![A-Za-z0-9])"), _crc_tail),
    "npm": (("npm_",), re.compile(rb"npm_([A-Za-z0-9]{30})([A-Za-z0-9]{6})(?![A-Za-z0-9])"), _crc_tail),
    "key": (("-----begin",), re.compile(rb"-----BEGIN (?:[A-Z]+ )*PRIVATE KEY-----"), lambda found: True),
    "card": (("card",), re.compile(rb"(?i:card)(?i:[ _-]?(?:no|number|nr))?\.?\x20*[:=#]?\x20*"
                                   rb"(?:[0-9]{4}[ -]?){3}[0-9]{4}(?![0-9])"), _luhn),
}
BASE = ("assign", "access", "hex")
KINDS = (*BASE, *(k for k in RULES if k not in BASE))
_IS_HEX = np.zeros(256, dtype=bool)
_IS_HEX[[*b"0123456789abcdef"]] = True


@cache
def _automaton() -> ahocorasick.Automaton:
    found = ahocorasick.Automaton()
    for kind, (keywords, _, _) in RULES.items():
        for word in keywords:
            found.add_word(word, (kind, len(word)))
    found.make_automaton()
    return found


def _hex_runs(raw: bytes) -> list[tuple[int, int]]:
    """Runs of at least ``HEX_RUN`` hexadecimal digits."""
    runs: list[tuple[int, int]] = []
    array = np.frombuffer(raw, dtype=np.uint8)
    for at in (np.flatnonzero(_IS_HEX[array[HEX_RUN - 1::HEX_RUN]]) * HEX_RUN + HEX_RUN - 1).tolist():
        if runs and at < runs[-1][1]:
            continue
        start, end = at, at + 1
        while start > 0 and _IS_HEX[raw[start - 1]]:
            start -= 1
        while end < len(raw) and _IS_HEX[raw[end]]:
            end += 1
        if end - start >= HEX_RUN:
            runs.append((start, end))
    return runs


def find_secrets(raw: bytes) -> list[tuple[int, int, str]]:
    """All secrets of a text as (start, end, kind), by start and then kind as listed; in code points."""
    spans = [(start, end, "hex") for start, end in _hex_runs(raw)]
    hits = [(end + 1 - length, kind) for end, (kind, length) in _automaton().iter(raw.lower().decode("latin-1"))]
    reached = dict.fromkeys(RULES, 0)
    for start, kind in sorted(hits):
        if start < reached[kind]:
            continue
        _, expression, holds = RULES[kind]
        found = expression.match(raw, start)
        if found:
            reached[kind] = found.end()
            if holds(found):
                spans.append((start, found.end(), kind))
    spans.sort(key=lambda s: (s[0], KINDS.index(s[2])))
    if not raw.isascii():
        # Bytes that continue a character do not count.
        points = np.cumsum((np.frombuffer(raw, dtype=np.uint8) & 0xC0) != 0x80) if spans else None
        spans = [(int(points[a]) - 1, int(points[b - 1]), kind) for a, b, kind in spans]
    return spans


def _listed(spans: list[tuple[int, int, str]]) -> str:
    return ",".join(f"{kind}:{start}:{end}" for start, end, kind in spans)


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = [find_secrets(text) for text in as_bytes(batch.column("text"))]
        counts = [pa.array([sum(s[2] == kind for s in spans) for spans in found], pa.int64()) for kind in BASE]
        digests = [hashlib.sha256(_listed([s for s in spans if s[2] in BASE]).encode()).hexdigest() for spans in found]
        yield pa.record_batch(
            [batch.column("doc_id"), *counts, pa.array(digests, pa.string()),
             pa.array([_listed(spans) for spans in found], pa.string())],
            ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"])


def scan(docs: DataFrame) -> DataFrame:
    """``docs(doc_id, text)`` -> counts of the base kinds, a digest of their spans, and all spans."""
    return docs.selectExpr("cast(doc_id as long) as doc_id", "text").mapInArrow(
        _scan, "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string")


def _masked(batches: Iterator[pa.RecordBatch], mark: str) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = batch.column("text").to_pylist()
        masked = []
        for text in texts:
            parts, upto = [], 0
            for start, end, kind in find_secrets((text or "").encode()):
                if end > upto:
                    parts += [text[upto:max(start, upto)], mark.format(kind=kind) if start >= upto else ""]
                    upto = end
            masked.append("".join([*parts, text[upto:]]) if parts else text)
        place = batch.schema.get_field_index("text")
        yield batch.set_column(place, "text", pa.array(masked, pa.string()))


def mask(docs: DataFrame, mark: str = "<{kind}>") -> DataFrame:
    """``docs`` with every secret in ``text`` replaced by ``mark``; other columns stay."""
    from functools import partial
    return docs.mapInArrow(partial(_masked, mark=mark), docs.schema)
