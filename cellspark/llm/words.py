"""Vectorised splitting and hashing of UTF-8 text, shared by the text operators.

All functions work on one Arrow batch: a flat byte array and the offsets of its
documents.  They cost a fixed number of NumPy passes over the bytes, so a very
long document is handled like many short ones.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Bytes of text that one call works on at once (a longer document stands alone).
BLOCK_BYTES = 1 << 21

_U = np.uint64


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit moves every output bit."""
    x = x ^ (x >> _U(33))
    x = x * _U(0xFF51AFD7ED558CCD)
    x = x ^ (x >> _U(33))
    x = x * _U(0xC4CEB9FE1A85EC53)
    return x ^ (x >> _U(33))


def table(seed: int, n: int) -> np.ndarray:
    """n fixed pseudo-random 64-bit values."""
    return mix(np.arange(1, n + 1, dtype=_U) * _U(0x9E3779B97F4A7C15) + _U(seed * 0x632BE59BD9B4E019 % 2**64))


_BYTE = table(1, 256)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def flat(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column and n + 1 offsets; null counts as empty."""
    texts = pa.array(texts) if not isinstance(texts, (pa.Array, pa.ChunkedArray)) else texts
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    if texts.null_count:
        texts = texts.fill_null("" if not pa.types.is_binary(texts.type) else b"")
    texts = texts.cast(pa.large_binary())
    _, off, data = texts.buffers()
    offsets = np.frombuffer(off, np.int64)[texts.offset : texts.offset + len(texts) + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


def blocks(texts: pa.Array, size: int = BLOCK_BYTES) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, bytes, offsets) of runs of rows of about ``size`` bytes."""
    raw, off = flat(texts)
    n, i = len(off) - 1, 0
    while i < n:
        j = int(np.searchsorted(off, off[i] + size, "right")) - 1
        j = min(n, max(i + 1, j))
        yield i, raw[off[i] : off[j]], off[i : j + 1] - off[i]
        i = j


def lower(raw: np.ndarray) -> np.ndarray:
    """A-Z to a-z; every other byte stays."""
    return _LOWER[raw]


def byte_class(inside) -> np.ndarray:
    """A table of 256 booleans from a predicate on byte values."""
    return np.array([bool(inside(b)) for b in range(256)])


#: Words between ASCII white space.
BY_SPACE = byte_class(lambda b: b != 32 and not 9 <= b <= 13)
#: Words of digits, a-z and everything beyond ASCII (after lower-casing).
BY_LETTER = byte_class(lambda b: 48 <= b <= 57 or 97 <= b <= 122 or b >= 128)


def words(raw: np.ndarray, off: np.ndarray, inside: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of words in the block, and the n + 1 word offsets of its rows."""
    if not len(raw):
        none = np.zeros(0, np.int64)
        return none, none, np.zeros(len(off), np.int64)
    ok = inside[raw]
    first = ok.copy()
    first[1:] &= ~ok[:-1]
    last = ok.copy()
    last[:-1] &= ~ok[1:]
    at = off[:-1][np.diff(off) > 0]  # a word never crosses the start of a row
    first[at] = ok[at]
    cut = at[at > 0] - 1
    last[cut] = ok[cut]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    return starts, ends, np.searchsorted(starts, off)


def hash_spans(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray, seed: int = 2) -> np.ndarray:
    """A 64-bit hash of each of the disjoint ascending spans."""
    if not len(starts):
        return np.zeros(0, _U)
    lens = ends - starts
    total = int(lens.sum())
    first = np.concatenate(([0], np.cumsum(lens)[:-1]))
    inner = np.arange(total) - np.repeat(first, lens)
    power = table(seed, int(lens.max())) | _U(1)
    part = _BYTE[raw[inner + np.repeat(starts, lens)]] ^ power[inner]
    part = (part ^ (part >> _U(29))) * power[inner]
    return mix(np.add.reduceat(part, first) + lens.astype(_U) * _U(0x9E3779B97F4A7C15))


def windows(hashes: np.ndarray, n: int, seed: int = 3) -> np.ndarray:
    """The hash of each run of n consecutive hashes; len(hashes) - n + 1 of them."""
    m = len(hashes) - n + 1
    if m <= 0:
        return np.zeros(0, _U)
    out = np.full(m, _U(seed * 0x9E3779B97F4A7C15 % 2**64))
    for i in range(n):
        out = out * _U(0xD6E8FEB86659FD93) + hashes[i : i + m]
        out = out ^ (out >> _U(32))
    return mix(out)
