"""Words and shingles of a batch of texts as numpy arrays: helpers for the operators' Arrow tasks.

A batch is cut into slices of a few megabytes of text, so the working arrays stay small however long the texts are. A
slice never splits a text. Hashes are 64-bit polynomials of the UTF-8 bytes followed by a mixing step; they depend on
the bytes only, so every executor gets the same value.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SLICE_BYTES = 1 << 19
_BASE = 0x9E3779B97F4A7C15
_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)

SPACES = bytes([0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D])
# Characters inside ASCII that end a word of letters and digits once A-Z are in lower case.
MARKS = bytes([*range(0x00, 0x30), *range(0x3A, 0x61), *range(0x7B, 0x80)])

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


BATCH_BYTES = 8 << 20


def small_batches(spark) -> None:
    """Let Arrow batches hold ``BATCH_BYTES`` at most, in this session: rows carry whole texts, and each task holds several batches."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if int(spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(spark.conf.get(key, "64m"))) > BATCH_BYTES:
        spark.conf.set(key, str(BATCH_BYTES))


def word_table(separators: bytes) -> np.ndarray:
    table = np.ones(256, dtype=bool)
    table[list(separators)] = False
    return table


SPACED, LETTERED = word_table(SPACES), word_table(MARKS)


def mix(x: np.ndarray) -> np.ndarray:
    """Spread every input bit over the whole 64-bit value."""
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


@lru_cache(maxsize=2)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    inverse = pow(_BASE, -1, 1 << 64)
    out = []
    for base in (_BASE, inverse):
        steps = np.full(n, base, dtype=np.uint64)
        steps[0] = 1
        out.append(np.multiply.accumulate(steps))
    return out[0], out[1]


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    return _powers(max(SLICE_BYTES, 1 << (n - 1).bit_length() if n > 1 else 1))


def slices(texts: pa.Array, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of at most ``limit`` bytes of text each, but one row at least."""
    sizes = pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    total = np.concatenate([[0], np.cumsum(sizes)])
    start = 0
    while start < len(sizes):
        stop = max(start + 1, int(np.searchsorted(total, total[start] + limit, side="right")) - 1)
        yield start, stop
        start = stop


class Words:
    """The words of some texts: ``starts``/``ends`` in ``data``, ``first[i]:first[i+1]`` are the words of text i."""

    def __init__(self, texts: pa.Array, table: np.ndarray = SPACED, lower: bool = True):
        texts = pc.fill_null(texts.cast(pa.large_string()), "")
        bounds = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset: texts.offset + len(texts) + 1]
        raw = texts.buffers()[2]
        data = np.frombuffer(raw, np.uint8)[bounds[0]: bounds[-1]] if raw is not None else np.zeros(0, np.uint8)
        self.raw, self.bounds = data, bounds - bounds[0]
        self.data = LOWER[data] if lower else data
        if not len(data):
            self.starts = self.ends = np.zeros(0, np.int64)
            self.first = np.zeros(len(texts) + 1, np.int64)
            return
        inside = table[self.data]
        edges = self.bounds[:-1][np.diff(self.bounds) > 0]
        before = np.empty_like(inside)
        before[0], before[1:] = False, inside[:-1]
        before[edges] = False
        after = np.empty_like(inside)
        after[-1], after[:-1] = False, inside[1:]
        after[edges[1:] - 1] = False
        self.starts = np.flatnonzero(inside & ~before)
        self.ends = np.flatnonzero(inside & ~after) + 1
        self.first = np.searchsorted(self.starts, self.bounds)

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def hashes(self, length: int | None = None) -> np.ndarray:
        """A 64-bit hash for each word, or for its first ``length`` bytes."""
        if not len(self.starts):
            return np.zeros(0, np.uint64)
        up, down = powers(len(self.data) + 1)
        sums = np.empty(len(self.data) + 1, np.uint64)
        sums[0] = 0
        np.cumsum((self.data.astype(np.uint64) + np.uint64(1)) * up[: len(self.data)], out=sums[1:])
        ends = self.ends if length is None else np.minimum(self.ends, self.starts + length)
        return mix((sums[ends] - sums[self.starts]) * down[self.starts])

    def word(self, i: int) -> bytes:
        return self.data[self.starts[i]: self.ends[i]].tobytes()

    def strings(self, which: np.ndarray) -> pa.Array:
        """The words at the given places as an Arrow array."""
        size = self.ends[which] - self.starts[which]
        bounds = np.concatenate([[0], np.cumsum(size)]).astype(np.int32)
        index = np.arange(bounds[-1]) + np.repeat(self.starts[which] - bounds[:-1], size)
        return pa.StringArray.from_buffers(len(which), pa.py_buffer(bounds), pa.py_buffer(self.data[index]))


def shingle_hashes(hashes: np.ndarray, first: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of ``size`` words, and where each text's runs begin.

    A text with fewer words, but some, has its whole word sequence as its one shingle; a text without words has none.
    """
    counts = np.diff(first)
    runs = np.where(counts >= size, counts - size + 1, np.minimum(counts, 1))
    bounds = np.concatenate([[0], np.cumsum(runs)])
    total = int(bounds[-1])
    out = np.zeros(total, np.uint64)
    if not total:
        return out, bounds
    at = np.arange(total) + np.repeat(first[:-1] - bounds[:-1], runs)
    left = np.repeat(np.minimum(counts, size), runs)
    multiplier = 1
    for step in range(size):
        multiplier = (multiplier * 0xD1342543DE82EF95 + 2 * step) % (1 << 64) | 1
        if step == 0:
            out += hashes[at] * np.uint64(multiplier)
        else:
            have = left > step
            out[have] += hashes[at[have] + step] * np.uint64(multiplier)
    return mix(out + left.astype(np.uint64)), bounds
