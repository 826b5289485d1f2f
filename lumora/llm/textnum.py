"""Texts as numpy arrays: bytes, words and their hashes, for a few megabytes of rows at a time.

Hashes are polynomials modulo 2**64 over a random value per byte, taken as differences of one running sum and then mixed.
Their constants are fixed, so all workers and reruns agree. Such polynomials meet for some pairs of unequal strings, whatever
the base: from 1024 bytes on, a Thue-Morse string and its complement. So words over LONG_WORD bytes have digests of their bytes
instead, and lines are compared by bytes where their hashes meet (``equals_earlier``).
"""

from __future__ import annotations

import ctypes
import hashlib
from collections.abc import Iterator
from functools import cached_property

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401

_RNG = np.random.default_rng(20240917)
BYTE_VALUES = _RNG.integers(0, 2**64, 256, dtype=np.uint64)
BYTE_VALUES_2 = _RNG.integers(0, 2**64, 256, dtype=np.uint64)
BASE = int(_RNG.integers(0, 2**63, dtype=np.uint64)) | 1
GRAM = np.uint64(int(_RNG.integers(0, 2**63, dtype=np.uint64)) | 1)
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True

#: Bytes of text that are turned into arrays at once (a longer text is taken alone); about 50 bytes of memory each.
CHUNK_BYTES = 2 << 20
#: Bytes of the longest words with hashes from running sums.
LONG_WORD = 64

_powers = {}


def powers(base: int, n: int) -> np.ndarray:
    """base**0 ... base**(n - 1) modulo 2**64."""
    have = _powers.get(base)
    if have is None or len(have) < n:
        steps = np.full(max(n, CHUNK_BYTES + 1), base, np.uint64)
        steps[0] = 1
        made = np.multiply.accumulate(steps)
        if n > CHUNK_BYTES + 1:  # of a long text: not kept
            return made
        have = _powers[base] = made
    return have[:n]


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads all bits."""
    h = h ^ (h >> np.uint64(32))
    h *= np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(29)
    h *= np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(32)
    return h


class RunningHash:
    """Hashes of slices of an array of bytes, or (without values for them) of 64-bit hashes."""

    def __init__(self, data: np.ndarray, values: np.ndarray | None = BYTE_VALUES, base: int = BASE):
        self.inverse = pow(base, -1, 2**64)
        self.sums = np.empty(len(data) + 1, np.uint64)
        self.sums[0] = 0
        np.cumsum((data if values is None else values[data]) * powers(base, len(data)), out=self.sums[1:])

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix((self.sums[end] - self.sums[start]) * powers(self.inverse, len(self.sums))[start] + (end - start).astype(np.uint64))


class Texts:
    """Some rows' texts. Nulls are empty texts."""

    def __init__(self, column: pa.Array):
        column = column.cast(pa.large_binary()).fill_null(b"")
        n = len(column)
        at = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + n + 1] if n else np.zeros(1, np.int64)
        raw = column.buffers()[2]
        self.data = np.frombuffer(raw, np.uint8)[at[0] : at[-1]] if raw is not None and at[-1] > at[0] else np.empty(0, np.uint8)
        self.offsets = at - at[0]
        self.n = n

    def __len__(self) -> int:
        return self.n

    @cached_property
    def words(self) -> tuple[np.ndarray, np.ndarray]:
        """Start and end of each word. Words don't cross texts."""
        solid = ~_SPACE[self.data]
        first = solid.copy()
        first[1:] &= ~solid[:-1]
        inner = self.offsets[(self.offsets > 0) & (self.offsets < len(solid))]
        first[inner] = solid[inner]
        last = solid.copy()
        last[:-1] &= ~solid[1:]
        last[inner - 1] = solid[inner - 1]
        return np.flatnonzero(first), np.flatnonzero(last) + 1

    @cached_property
    def word_offsets(self) -> np.ndarray:
        """Where each text's words begin among all words; one more at the end."""
        return np.searchsorted(self.words[0], self.offsets)

    @cached_property
    def word_doc(self) -> np.ndarray:
        return np.repeat(np.arange(self.n), np.diff(self.word_offsets))

    @cached_property
    def hash(self) -> RunningHash:
        return RunningHash(self.data)

    @cached_property
    def word_hash(self) -> np.ndarray:
        starts, ends = self.words
        out = self.hash.of(starts, ends)
        for i in np.flatnonzero(ends - starts > LONG_WORD):
            out[i] = int.from_bytes(hashlib.blake2b(self.data[starts[i] : ends[i]].tobytes(), digest_size=8).digest(), "little")
        return out

    def equals_earlier(self, starts: np.ndarray, ends: np.ndarray, docs: np.ndarray) -> np.ndarray:
        """Which slices equal an earlier one of their text, by bytes; only slices whose hashes meet are looked at."""
        salt = mix(np.arange(1, self.n + 1, dtype=np.uint64))
        out, seen = np.zeros(len(starts), bool), set()
        for i in np.flatnonzero(repeated(self.hash.of(starts, ends) + salt[docs])):
            key = (int(docs[i]), self.data[starts[i] : ends[i]].tobytes())
            out[i] = key in seen
            seen.add(key)
        return out

    @cached_property
    def points_before(self) -> np.ndarray:
        """Code points before each byte; one more at the end."""
        out = np.zeros(len(self.data) + 1, np.int64)
        np.cumsum((self.data & 0xC0) != 0x80, out=out[1:])
        return out

    def per_doc(self, values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Sums of values by text, for the texts' offsets among the values."""
        sums = np.zeros(len(values) + 1, np.int64)
        np.cumsum(values, out=sums[1:])
        return sums[offsets[1:]] - sums[offsets[:-1]]

    def grams(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        """Index of the first word and hash of each run of n words within a text."""
        w = self.word_hash
        if len(w) < n:
            return np.empty(0, np.int64), np.empty(0, np.uint64)
        h = w[: len(w) - n + 1].copy()
        for j in range(1, n):
            h = h * GRAM + w[j : len(w) - n + 1 + j]
        first = np.flatnonzero(self.word_doc[: len(w) - n + 1] == self.word_doc[n - 1 :])
        return first, mix(h[first])


def repeated(keys: np.ndarray) -> np.ndarray:
    """Which keys occur more than once."""
    order = np.argsort(keys)
    k = keys[order]
    same = np.zeros(len(k) + 1, bool)
    same[1:-1] = k[1:] == k[:-1]
    out = np.empty(len(k), bool)
    out[order] = same[:-1] | same[1:]
    return out


def covered(first: np.ndarray, length: int | np.ndarray, n: int) -> np.ndarray:
    """Which of n places lie in one of the runs that start at `first`."""
    steps = np.zeros(n + 1, np.int32)
    np.add.at(steps, first, 1)
    np.add.at(steps, first + length, -1)
    return np.cumsum(steps[:-1]) > 0


class Tally:
    """Sums of counts by 64-bit key, in bounded memory for a bounded number of keys."""

    def __init__(self):
        self.keys, self.sums, self.parts, self.waiting = np.empty(0, np.uint64), np.empty(0, np.int64), [], 0

    def add(self, keys: np.ndarray, counts: np.ndarray) -> None:
        self.parts.append((keys, counts))
        self.waiting += len(keys)
        if self.waiting > 1_000_000:
            self.fold()

    def fold(self) -> None:
        keys = np.concatenate([self.keys, *(k for k, _ in self.parts)])
        sums = np.concatenate([self.sums, *(c for _, c in self.parts)])
        self.keys, at = np.unique(keys, return_inverse=True)
        self.sums = np.bincount(at, weights=sums, minlength=len(self.keys)).astype(np.int64)
        self.parts, self.waiting = [], 0

    def in_slices(self, most: int = 200_000) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        self.fold()
        for a in range(0, len(self.keys), most):
            yield self.keys[a : a + most], self.sums[a : a + most]


def task_part() -> int:
    from pyspark import TaskContext

    return TaskContext.get().partitionId()


def rows_of(schema: str, *columns) -> pa.RecordBatch:
    """A batch of a schema of integers; a single number stands for a column of it."""
    names, kinds = zip(*(x.split() for x in schema.split(", ")), strict=True)
    n = next(len(c) for c in columns if isinstance(c, np.ndarray))
    wide = {"byte": np.int8, "int": np.int32, "long": np.int64}
    arrays = [c.view(np.int64) if isinstance(c, np.ndarray) and c.dtype == np.uint64 else c if isinstance(c, np.ndarray) else np.full(n, c) for c in columns]
    return pa.RecordBatch.from_arrays([pa.array(c.astype(wide[k], copy=False)) for c, k in zip(arrays, kinds, strict=True)], list(names))


def trim() -> None:
    """Give freed memory back to the system: workers live on between tasks and share an executor's memory."""
    pa.default_memory_pool().release_unused()
    free = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if free is not None:
        free(0)


def chunks(batches: Iterator[pa.RecordBatch], text: str = "text", most: int = CHUNK_BYTES) -> Iterator[tuple[pa.RecordBatch, Texts]]:
    """Slices of the batches with about `most` bytes of text, or one row if that is longer. Freed memory is given back at the end."""
    try:
        yield from _slices(batches, text, most)
    finally:
        trim()


def _slices(batches: Iterator[pa.RecordBatch], text: str, most: int) -> Iterator[tuple[pa.RecordBatch, Texts]]:
    for batch in batches:
        if not batch.num_rows:
            continue
        column = batch.column(batch.schema.get_field_index(text))
        sizes = np.asarray(pa.compute.fill_null(pa.compute.binary_length(column), 0).to_numpy(zero_copy_only=False), np.int64)
        ends = np.cumsum(sizes)
        start = 0
        while start < len(sizes):
            base = ends[start - 1] if start else 0
            stop = max(start + 1, int(np.searchsorted(ends, base + most, "right")))
            part = batch.slice(start, stop - start)
            yield part, Texts(part.column(part.schema.get_field_index(text)))
            start = stop
