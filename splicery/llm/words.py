"""Words of Arrow string columns as numpy arrays: byte offsets and 64-bit hashes, a block of rows at a time."""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text that are scanned at once; a longer text is scanned in windows of about this size.
BLOCK = 1 << 20

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
#: Bytes of words [^\x20\x09-\x0D]+ .
NOT_WHITE = np.ones(256, bool)
NOT_WHITE[[32, *range(9, 14)]] = False
#: Bytes of words [^\x00-\x2F\x3A-\x60\x7B-\x7F]+ in lower-cased text: digits, a-z, all beyond ASCII.
ALNUM = np.zeros(256, bool)
ALNUM[48:58] = ALNUM[97:123] = ALNUM[128:] = True

_ODD = np.uint64(0x9E3779B97F4A7C15)
_powers: dict[str, np.ndarray] = {}


class Words(NamedTuple):
    """The words of the rows first..last-1 of a column: row (from 0 in this block) and hash of each."""

    first: int
    last: int
    row: np.ndarray
    hash: np.ndarray


def mixed(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser, element by element."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd base modulo 2**64, and of its inverse."""
    if len(_powers.get("up", ())) < n:
        base = 0x2545F4914F6CDD1D
        for name, b in (("up", base), ("down", pow(base, -1, 1 << 64))):
            p = np.full(max(n, BLOCK + 1), b, np.uint64)
            p[0] = 1
            _powers[name] = np.cumprod(p)
    return _powers["up"], _powers["down"]


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of all rows and the rows' offsets; null counts as empty."""
    column = pc.fill_null(column, "").cast(pa.large_string())
    _, offsets, data = column.buffers()
    offs = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    return (np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)), offs


def spans(data: np.ndarray, breaks: np.ndarray, is_word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and end of each word of a block; a new row begins at each of `breaks`."""
    w = is_word[data]
    head, tail = w.copy(), w.copy()
    head[1:] &= ~w[:-1]
    tail[:-1] &= ~w[1:]
    inner = breaks[(breaks > 0) & (breaks < len(data))]
    head[inner] = w[inner]
    tail[inner - 1] = w[inner - 1]
    return np.flatnonzero(head), np.flatnonzero(tail) + 1


def hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A polynomial hash of data[start:end] for each word, from one prefix sum."""
    up, down = _power(len(data) + 1)
    total = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[: len(data)], out=total[1:])
    return mixed((total[end] - total[start]) * down[start])


def blocks(column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, last row + 1, bytes lower-cased, offsets in them) of runs of rows of about BLOCK bytes."""
    data, offs = buffers(column)
    first, n = 0, len(offs) - 1
    while first < n:
        last = max(first + 1, int(np.searchsorted(offs, offs[first] + BLOCK, "right")) - 1)
        last = min(last, n)
        yield first, last, _LOWER[data[offs[first] : offs[last]]], offs[first : last + 1] - offs[first]
        first = last


def windows(data: np.ndarray, is_word: np.ndarray) -> Iterator[tuple[int, int]]:
    """Cuts of a long text that never fall inside a word."""
    at = 0
    while at < len(data):
        to = min(len(data), at + BLOCK)
        while to < len(data) and is_word[data[to]]:
            to += 1
        yield at, to
        at = to


def words(column: pa.Array, is_word: np.ndarray) -> Iterator[Words]:
    """The hashed words of every row, in order."""
    for first, last, data, offs in blocks(column):
        if len(data) <= 2 * BLOCK:
            start, end = spans(data, offs[1:-1], is_word)
            yield Words(first, last, np.searchsorted(offs, start, "right") - 1, hashes(data, start, end))
        else:  # one long text
            parts = []
            for a, b in windows(data, is_word):
                start, end = spans(data[a:b], np.zeros(0, np.int64), is_word)
                parts.append(hashes(data[a:b], start, end))
            h = np.concatenate(parts)
            yield Words(first, last, np.full(len(h), np.searchsorted(offs, 0, "right") - 1), h)
