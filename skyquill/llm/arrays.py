"""Whole-batch tokenising and hashing over Arrow string buffers.

Texts arrive as Arrow batches. A batch is cut into chunks of half a megabyte,
and each chunk is handled as one flat byte array: word borders, word hashes and
shingle hashes come from a handful of numpy passes, so no Python code runs per
word. A word is a run of bytes other than ``\\x20`` and ``\\x09``-``\\x0D``; these
are single bytes in UTF-8, so byte borders are code point borders.

Hashes are 64 bits wide: a sum of table values times powers of an odd number,
followed by an avalanche step. Null texts count as empty.
"""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

CHUNK_BYTES = 1 << 19
BATCH_ROWS = 512

_U = np.uint64
_BASE = 0x9E3779B97F4A7C15 | 1
_MIX1, _MIX2 = _U(0xBF58476D1CE4E5B9), _U(0x94D049BB133111EB)
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, 9, 10, 11, 12, 13]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
#: Letters and digits; bytes of other scripts count as letters.
_LETTER = np.zeros(256, dtype=bool)
_LETTER[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True
_TABLE = np.random.default_rng(20240117).integers(1, 2**64 - 1, 256, dtype=np.uint64)
_powers: dict[str, np.ndarray] = {}


def mix(h: np.ndarray) -> np.ndarray:
    """Avalanche 64-bit values (splitmix64 finaliser)."""
    h = (h ^ (h >> _U(30))) * _MIX1
    h = (h ^ (h >> _U(27))) * _MIX2
    return h ^ (h >> _U(31))


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse, at least n of each."""
    if len(_powers.get("up", ())) < n:
        size = max(n, CHUNK_BYTES + 1)
        for name, base in (("up", _BASE), ("down", pow(_BASE, -1, 2**64))):
            steps = np.full(size, _U(base), dtype=np.uint64)
            steps[0] = 1
            _powers[name] = np.multiply.accumulate(steps)
    return _powers["up"], _powers["down"]


@dataclass
class Chunk:
    """Words of some rows. ``row`` is the row of each word, from 0; ``first`` and ``count`` are by row."""

    data: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    row: np.ndarray
    first: np.ndarray
    count: np.ndarray
    _sums: np.ndarray | None = None

    @property
    def n_rows(self) -> int:
        return len(self.first)

    def sums(self) -> np.ndarray:
        """Prefix sums of the weighted bytes: sums[j] - sums[i] belongs to bytes i..j."""
        if self._sums is None:
            up, _ = _power(len(self.data) + 1)
            out = np.empty(len(self.data) + 1, dtype=np.uint64)
            out[0] = 0
            np.cumsum(_TABLE[self.data] * up[: len(self.data)], out=out[1:])
            self._sums = out
        return self._sums

    def span_hash(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Hash of the bytes of each span."""
        sums, (_, down) = self.sums(), _power(len(self.data) + 1)
        return mix((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64))

    def word_hash(self) -> np.ndarray:
        return self.span_hash(self.starts, self.ends)

    def bare_words(self) -> tuple[np.ndarray, np.ndarray]:
        """(row, hash) of every word without the marks around it; words without a letter or digit are left out."""
        n = len(self.data)
        place, letter = np.arange(n), _LETTER[self.data]
        last = np.maximum.accumulate(np.where(letter, place, -1)) if n else place
        first = np.minimum.accumulate(np.where(letter, place, n)[::-1])[::-1] if n else place
        keep = np.flatnonzero(first[self.starts] < self.ends) if len(self.starts) else np.zeros(0, np.int64)
        return self.row[keep], self.span_hash(first[self.starts[keep]], last[self.ends[keep] - 1] + 1)


def task(run: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """``run`` over a task's batches, which gives its memory back at the end: a worker waits for its next task without it."""

    def whole(batches):
        try:
            yield from run(batches)
        finally:
            pa.default_memory_pool().release_unused()
            try:
                ctypes.CDLL("libc.so.6").malloc_trim(0)
            except (OSError, AttributeError):
                pass  # another C library, which has its own way

    return whole


def text_column(batch: pa.RecordBatch, name: str) -> pa.Array:
    """The column as a string array without nulls."""
    column = batch.column(batch.schema.get_field_index(name))
    if column.null_count:
        column = column.fill_null("")
    return column.cast(pa.string()) if column.type != pa.string() else column


def chunks(texts: pa.Array, lower: bool, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int, Chunk]]:
    """(first row, end row, words) for runs of rows of at most ``limit`` bytes, one row at least."""
    offsets = np.frombuffer(texts.buffers()[1], dtype=np.int32)[texts.offset : texts.offset + len(texts) + 1]
    raw = texts.buffers()[2]
    data = np.frombuffer(raw, dtype=np.uint8) if raw is not None else np.zeros(0, np.uint8)
    at = 0
    while at < len(texts):
        end = max(at + 1, int(np.searchsorted(offsets, offsets[at] + limit, side="right")) - 1)
        end = min(end, len(texts))
        yield at, end, _chunk(data[offsets[at] : offsets[end]], (offsets[at : end + 1] - offsets[at]).astype(np.int64), lower)
        at = end


def _chunk(data: np.ndarray, offsets: np.ndarray, lower: bool) -> Chunk:
    if lower:
        data = _LOWER[data]
    space = _SPACE[data]
    n = len(data)
    begin, stop = np.empty(n, dtype=bool), np.empty(n, dtype=bool)
    if n:
        begin[0] = stop[-1] = True
        begin[1:], stop[:-1] = space[:-1], space[1:]
        cut = offsets[1:-1]
        cut = cut[(cut > 0) & (cut < n)]
        begin[cut] = True
        stop[cut - 1] = True
        np.logical_and(begin, ~space, out=begin)
        np.logical_and(stop, ~space, out=stop)
    starts, ends = np.flatnonzero(begin), np.flatnonzero(stop) + 1
    first = np.searchsorted(starts, offsets[:-1])
    count = np.searchsorted(starts, offsets[1:]) - first
    return Chunk(data, starts, ends, np.repeat(np.arange(len(first)), count), first, count)


def windows(words: np.ndarray, chunk: Chunk, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, hash) of every window of k words inside a row; a shorter row that has words is one window."""
    out, rows = np.zeros(0, np.uint64), np.zeros(0, np.int64)
    if len(words) >= k:
        h = np.zeros(len(words) - k + 1, dtype=np.uint64)
        for j in range(k):
            h = h * _U(_BASE) + words[j : len(words) - k + 1 + j]
        whole = chunk.row[: len(h)] == chunk.row[k - 1 :]
        out, rows = mix(h[whole]), chunk.row[: len(h)][whole]
    short = np.flatnonzero((chunk.count > 0) & (chunk.count < k))
    if len(short):
        h = np.zeros(len(short), dtype=np.uint64)
        for j in range(k - 1):
            has = chunk.count[short] > j
            at = np.minimum(chunk.first[short] + j, len(words) - 1)
            h = np.where(has, h * _U(_BASE) + words[at], h)
        out = np.concatenate([out, mix(h + chunk.count[short].astype(np.uint64))])
        rows = np.concatenate([rows, short])
    return rows, out


def row_sets(rows: np.ndarray, hashes: np.ndarray, n_rows: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct hashes by row, ascending: (row of each, hash of each, number by row)."""
    order = np.lexsort((hashes, rows))
    rows, hashes = rows[order], hashes[order]
    if len(rows):
        keep = np.empty(len(rows), dtype=bool)
        keep[0] = True
        keep[1:] = (rows[1:] != rows[:-1]) | (hashes[1:] != hashes[:-1])
        rows, hashes = rows[keep], hashes[keep]
    return rows, hashes, np.bincount(rows, minlength=n_rows)


def by_row_sum(row: np.ndarray, values: np.ndarray, n_rows: int) -> np.ndarray:
    return np.bincount(row, weights=values, minlength=n_rows)
