"""Words and word hashes of whole texts, computed in bulk on byte arrays.

Words are runs of bytes other than space, tab, line feed, vertical tab, form
feed and carriage return; only A-Z are lower-cased. Hashes depend on nothing
but the bytes of a word, so every task and every run agrees on them.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence

import numpy as np

# Text hashed at once; bounds the arrays that a task holds for one step.
PIECE_BYTES = 1 << 20
_SPACE = re.compile(rb"[\x09-\x0d\x20]")
_IS_SPACE = np.zeros(256, dtype=bool)
_IS_SPACE[[9, 10, 11, 12, 13, 32]] = True
_U = np.uint64
_STEP = 0x9E3779B97F4A7C15


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection on 64-bit numbers in which every input bit reaches every output bit."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def numbered(count: int, seed: int) -> np.ndarray:
    """Pseudo-random 64-bit numbers fixed by ``seed``."""
    return mix(np.arange(1, count + 1, dtype=_U) * _U(_STEP) + _U(seed))


_BYTE_VALUE = numbered(256, 11)
_BASE = 0xD1342543DE82EF95
_powers: tuple[np.ndarray, np.ndarray] | None = None


def _power_tables(size: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd base modulo 2**64, and of its inverse."""
    global _powers
    if _powers is None or len(_powers[0]) < size:
        tables = []
        for base in (_BASE, pow(_BASE, -1, 1 << 64)):
            table = np.full(size, base, dtype=_U)
            table[0] = 1
            tables.append(np.multiply.accumulate(table))
        _powers = (tables[0], tables[1])
    return _powers


def _pieces(blob: bytes) -> Iterator[tuple[int, int]]:
    """Stretches of about ``PIECE_BYTES``, cut before white space only."""
    start = 0
    while start < len(blob):
        found = _SPACE.search(blob, min(start + PIECE_BYTES, len(blob)))
        end = found.start() if found else len(blob)
        yield start, end
        start = end


def word_hashes(texts: Sequence[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words in order, and where each text's words begin in them.

    The second array has one entry more than there are texts.
    """
    blob = b"\n".join(texts).lower()
    offsets = np.cumsum([0, *(len(t) + 1 for t in texts)])
    hashes, places = [], []
    for begin, end in _pieces(blob):
        part = np.frombuffer(blob, dtype=np.uint8, count=end - begin, offset=begin)
        solid = np.zeros(len(part) + 2, dtype=np.int8)
        solid[1:-1] = ~_IS_SPACE[part]
        edges = np.diff(solid)
        starts, ends = np.flatnonzero(edges == 1), np.flatnonzero(edges == -1)
        ahead, back = _power_tables(max(PIECE_BYTES, len(part)))
        sums = np.zeros(len(part) + 1, dtype=_U)
        np.cumsum(_BYTE_VALUE[part] * ahead[:len(part)], out=sums[1:])
        # A shift by the start makes equal words equal wherever they stand.
        hashes.append(mix((sums[ends] - sums[starts]) * back[starts] + (ends - starts).astype(_U)))
        places.append(starts + begin)
    if not hashes:
        return np.zeros(0, dtype=_U), np.zeros(len(texts) + 1, dtype=np.int64)
    return np.concatenate(hashes), np.searchsorted(np.concatenate(places), offsets)


def shingle_sets(texts: Sequence[bytes], width: int) -> list[np.ndarray]:
    """The sorted distinct ``width``-word shingles of each text, as hashes.

    A text of fewer words is one shingle; one without words has none.
    """
    hashes, first = word_hashes(texts)
    factors = numbered(width, 29) | _U(1)
    long = np.zeros(max(0, len(hashes) - width + 1), dtype=_U)
    for k in range(width):
        long += hashes[k:len(long) + k] * factors[k]
    long = mix(long)
    sets = []
    places = first.tolist()
    for begin, end in zip(places[:-1], places[1:]):
        count = end - begin
        if count >= width:
            sets.append(np.unique(long[begin:end - width + 1]))
        elif count:
            short = (hashes[begin:end] * factors[:count]).sum(keepdims=True, dtype=_U)
            sets.append(mix(short + _U(_STEP * count % 2 ** 64)))
        else:
            sets.append(np.zeros(0, dtype=_U))
    return sets


def by_bytes(texts: Sequence[bytes], limit: int = PIECE_BYTES) -> Iterator[slice]:
    """Neighbouring texts of at most ``limit`` bytes together; a longer one stands alone."""
    start, size = 0, 0
    for i, text in enumerate(texts):
        if i > start and size + len(text) > limit:
            yield slice(start, i)
            start, size = i, 0
        size += len(text)
    if start < len(texts):
        yield slice(start, len(texts))


def as_bytes(column) -> list[bytes]:
    """The UTF-8 bytes of an Arrow string column; a null is empty."""
    return [value or b"" for value in column.cast("binary").to_pylist()]
