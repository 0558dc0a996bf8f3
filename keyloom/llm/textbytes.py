"""Words, lines and their 64-bit hashes for whole Arrow batches of texts, with numpy.

A batch's texts are one run of UTF-8 bytes, so a text is never cut, and no Python code
runs per word. A hash is a polynomial over random byte values modulo 2**64, mixed with
the length; case folding of A-Z is part of the byte values.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

BLOCK_BYTES = 1 << 20
_ODD = np.uint64(0x9E3779B97F4A7C15)


def _spaces() -> np.ndarray:
    sep = np.zeros(256, bool)
    sep[[0x20, *range(0x09, 0x0E)]] = True
    return sep


def _non_alnum() -> np.ndarray:
    sep = np.zeros(256, bool)
    sep[0x00:0x30] = sep[0x3A:0x41] = sep[0x5B:0x61] = sep[0x7B:0x80] = True
    return sep


def _newline() -> np.ndarray:
    sep = np.zeros(256, bool)
    sep[0x0A] = True
    return sep


SPACES, NON_ALNUM, NEWLINE = _spaces(), _non_alnum(), _newline()


def _byte_values(fold: bool) -> np.ndarray:
    values = np.random.default_rng(20240229).integers(1, 1 << 63, 256, dtype=np.uint64)
    if fold:
        values[ord("A"):ord("Z") + 1] = values[ord("a"):ord("z") + 1]
    return values


FOLDED, EXACT = _byte_values(True), _byte_values(False)
_POWERS: dict[str, np.ndarray] = {}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd base and of its inverse, kept in the worker up to the longest block seen."""
    if len(_POWERS.get("up", ())) < n:
        inverse = np.uint64(pow(int(_ODD), -1, 1 << 64))
        with np.errstate(over="ignore"):
            for name, base in (("up", _ODD), ("down", inverse)):
                run = np.full(n, base, np.uint64)
                run[0] = 1
                _POWERS[name] = np.multiply.accumulate(run)
    return _POWERS["up"][:n], _POWERS["down"][:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit (the splitmix64 finish)."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def combine(*parts: np.ndarray) -> np.ndarray:
    """Order-sensitive hash of several hash columns."""
    with np.errstate(over="ignore"):
        out = np.zeros(len(parts[0]), np.uint64)
        for p in parts:
            out = mix(out * _ODD + p.astype(np.uint64) + np.uint64(1))
        return out


def texts(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a string column and the row offsets in them; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string()).fill_null("")
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset:column.offset + len(column) + 1]
    if column.buffers()[2] is None or not len(column):
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    return np.frombuffer(column.buffers()[2], np.uint8)[offsets[0]:offsets[-1]], offsets - offsets[0]


def blocks(data: np.ndarray, offsets: np.ndarray, limit: int = BLOCK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Consecutive rows of about ``limit`` bytes together; a longer text is a block of its own."""
    rows, first = len(offsets) - 1, 0
    while first < rows:
        last = max(first + 1, int(np.searchsorted(offsets, offsets[first] + limit, "right")) - 1)
        yield first, last, data[offsets[first]:offsets[last]], offsets[first:last + 1] - offsets[first]
        first = last


def runs(data: np.ndarray, offsets: np.ndarray, separators: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, row) of every maximal run without separators; runs end with their row."""
    inside = ~separators[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    before = np.empty(len(data), bool)
    after = np.empty(len(data), bool)
    if len(data):
        before[0] = after[-1] = False
        before[1:], after[:-1] = inside[:-1], inside[1:]
    starts = np.flatnonzero(inside & (~before | edge[:-1]))
    ends = np.flatnonzero(inside & (~after | edge[1:])) + 1
    return starts, ends, np.searchsorted(offsets, starts, "right") - 1


def hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, values: np.ndarray = FOLDED) -> np.ndarray:
    """64-bit hash of the bytes of each run."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    up, down = _powers(len(data) + 1)
    with np.errstate(over="ignore"):
        total = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(values[data] * up[:-1], out=total[1:])
        return mix((total[ends] - total[starts]) * down[starts] + (ends - starts).astype(np.uint64) * _ODD)


def words(data: np.ndarray, offsets: np.ndarray, separators: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, case-folded hash) of every word in order."""
    starts, ends, row = runs(data, offsets, separators)
    return row, hashes(data, starts, ends)


def word_hashes(text: str, separators: np.ndarray) -> np.ndarray:
    data = np.frombuffer(text.encode(), np.uint8)
    return words(data, np.array([0, len(data)]), separators)[1]


def per_row(row: np.ndarray, rows: int) -> np.ndarray:
    """How many entries each row has."""
    return np.bincount(row, minlength=rows).astype(np.int64)


def signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)
