"""Words and word hashes of Arrow text columns, computed over whole blocks of bytes with NumPy.

All word classes here are made of ASCII bytes and "everything above U+007F", and only A-Z is lower-cased, so UTF-8 bytes can
be classified one by one. Work goes block by block (about a megabyte of text), so memory is bounded by the word hashes
of the longest text.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa

BLOCK = 1 << 20
_MUL = np.uint64(0x9E3779B97F4A7C15)
_P = 0xD6E8FEB86659FD93
_INVERSE = np.uint64(pow(_P, -1, 1 << 64))

#: Bytes of a word for ``[^\x20\x09-\x0D]+``.
SPACED = np.ones(256, bool)
SPACED[[0x20, *range(0x09, 0x0E)]] = False
#: Bytes of a word for ``[^\x00-\x2F\x3A-\x60\x7B-\x7F]+`` after lower-casing: digits, letters, all beyond ASCII.
ALNUM = np.zeros(256, bool)
ALNUM[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True
#: A-Z lower-cased.
FOLD = np.arange(256, dtype=np.uint8)
FOLD[0x41:0x5B] += 32


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


#: A random value for each byte, the same for A-Z and a-z.
_VALUE = mix64(np.arange(1, 257, dtype=np.uint64) * _MUL)[FOLD]


@lru_cache(2)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    up, down = np.full(n, np.uint64(_P)), np.full(n, _INVERSE)
    up[0] = down[0] = 1
    return np.multiply.accumulate(up), np.multiply.accumulate(down)


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a text column, and where each row starts and the last one ends. Null rows are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string())
    if column.null_count:
        column = column.fill_null("")
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    return (np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)), at


def word_spans(buf: np.ndarray, kind: np.ndarray, breaks: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Byte offsets at which words start and end (exclusive). A word ends at each of ``breaks`` too."""
    inside = kind[buf]
    edge = np.empty(len(buf) + 1, bool)
    edge[0] = edge[-1] = True
    edge[1:-1] = inside[1:] != inside[:-1]
    if breaks is not None:
        edge[breaks] = True
    at = np.flatnonzero(edge)
    keep = inside[at[:-1]] if len(buf) else np.zeros(0, bool)
    return at[:-1][keep], at[1:][keep]


def _hash_spans(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    if not len(starts):
        return np.zeros(0, np.uint64)
    size = 1 << max(20, int(len(buf)).bit_length())
    up, down = _powers(size)
    sums = np.zeros(len(buf) + 1, np.uint64)
    np.cumsum(_VALUE[buf] * up[: len(buf)], out=sums[1:])
    return mix64((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64) * _MUL)


def blocks(buf: np.ndarray, at: np.ndarray, limit: int = BLOCK) -> Iterator[tuple[int, int]]:
    """Row ranges of about ``limit`` bytes; a longer row stands alone."""
    row = 0
    while row < len(at) - 1:
        end = max(row + 1, int(np.searchsorted(at, at[row] + limit, "right")) - 1)
        yield row, end
        row = end


def hashed_words(column: pa.Array, kind: np.ndarray) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """For each block of rows: first row, end row, the hashes of all its words, and where each row's words start in these."""
    buf, at = text_bytes(column)
    for first, end in blocks(buf, at):
        part, rows = buf[at[first] : at[end]], at[first : end + 1] - at[first]
        if len(part) <= 4 * BLOCK:
            starts, ends = word_spans(part, kind, rows)
            yield first, end, _hash_spans(part, starts, ends), np.searchsorted(starts, rows)
        else:
            hashes = np.concatenate([_hash_spans(p, *word_spans(p, kind)) for p in pieces(part, kind)])
            yield first, end, hashes, np.array([0, len(hashes)])


def pieces(part: np.ndarray, kind: np.ndarray, limit: int = BLOCK) -> Iterator[np.ndarray]:
    """A long text in pieces of about ``limit`` bytes, cut between words only."""
    while len(part) > limit:
        gaps = np.flatnonzero(~kind[part[:limit]])
        if len(gaps):
            cut = int(gaps[-1]) + 1
        else:
            gap = np.flatnonzero(~kind[part[limit:]])
            cut = limit + int(gap[0]) + 1 if len(gap) else len(part)
        yield part[:cut]
        part = part[cut:]
    yield part


def shingles(words: np.ndarray, width: int) -> np.ndarray:
    """Hashes of all runs of ``width`` words; of the whole sequence where it is shorter; none where it is empty."""
    if not len(words):
        return words
    width = min(width, len(words))
    out = np.full(len(words) - width + 1, np.uint64(width))
    for j in range(width):
        out = mix64(out * _MUL + words[j : j + len(out)])
    return out
