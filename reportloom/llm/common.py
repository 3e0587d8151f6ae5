"""Shared pieces of the training-data operators.

``Words`` finds and hashes the words of a block of texts with whole-array operations on
the UTF-8 bytes of an Arrow column; no Python object is made per word. A word is a
maximal run of bytes other than space, tab, line feed, vertical tab, form feed and
carriage return, which is ``[^\\x20\\x09-\\x0D]+`` in characters too.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Bytes of text handled at a time; a longer single text is one block.
BLOCK_BYTES = 2 << 20

SPACES = np.zeros(256, bool)
SPACES[[0x20, *range(0x09, 0x0E)]] = True

_GOLDEN = np.uint64(0x9E3779B97F4A7C15)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit mixer (two xor-multiply steps)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _byte_values(seed: int) -> np.ndarray:
    return mix(np.arange(1, 257, dtype=np.uint64) * _GOLDEN + np.uint64(seed))


#: Elements hashed at a time, so that powers and running sums stay small whatever the length of a text.
SEGMENT = 1 << 16


class _Powers:
    """Powers of an odd base and of its inverse modulo 2**64; those for a segment are kept."""

    def __init__(self, base: int):
        self.base, self.inverse = np.uint64(base), np.uint64(pow(base, -1, 1 << 64))
        self.kept = self.run(2 * SEGMENT + 1)

    def run(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        def powers(factor):
            out = np.full(n, factor, np.uint64)
            out[0] = 1
            return np.multiply.accumulate(out)
        return powers(self.base), powers(self.inverse)

    def get(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        up, down = self.kept if n <= len(self.kept[0]) else self.run(n)
        return up[:n], down[:n]


_POWERS = {0: _Powers(0xD6E8FEB86659FD93), 1: _Powers(0xA0761D6478BD642F)}
_BYTES = {0: _byte_values(11), 1: _byte_values(23)}


def span_hashes(values: np.ndarray, starts: np.ndarray, ends: np.ndarray, seed: int = 0, table: np.ndarray | None = None) -> np.ndarray:
    """64-bit hashes of ``values[starts:ends]``, equal for equal contents wherever they stand.

    ``starts`` ascend. Values go through ``table`` where one is given. Spans are taken by segments of their starts; only a
    span longer than a segment needs longer arrays, which are not kept.
    """
    out = np.zeros(len(starts), np.uint64)
    first = 0
    while first < len(starts):
        low = int(starts[first])
        last = int(np.searchsorted(starts, low + SEGMENT))
        own, stop = starts[first:last] - low, ends[first:last] - low
        part = values[low:low + int(stop.max(initial=0))]
        part = part if table is None else table[part]
        up, down = _POWERS[seed].get(len(part) + 1)
        sums = np.zeros(len(part) + 1, np.uint64)
        np.cumsum(part * up[:-1], out=sums[1:])
        out[first:last] = (sums[stop] - sums[own]) * down[own] + (stop - own).astype(np.uint64) * _GOLDEN
        first = last
    return mix(out) if len(out) else out


def byte_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, seed: int = 0) -> np.ndarray:
    return span_hashes(data, starts, ends, seed, _BYTES[seed])


def blocks(column: pa.Array, limit: int = BLOCK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Cut a string column into runs of rows of about ``limit`` bytes.

    Yields first row, row after the last, the bytes, and the offsets of the texts in
    them (one more than rows). A null text is empty.
    """
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    column = column.cast(pa.large_binary())
    n = len(column)
    if not n:
        return
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset: column.offset + n + 1]
    held = column.buffers()[2]
    data = np.frombuffer(held, np.uint8) if held is not None and held.size else np.zeros(0, np.uint8)
    first = 0
    while first < n:
        last = max(first + 1, int(np.searchsorted(offsets, offsets[first] + limit, "right")) - 1)
        last = min(last, n)
        yield first, last, data[offsets[first]:offsets[last]], offsets[first:last + 1] - offsets[first]
        first = last


class Words:
    """Places of all words of a block: ``starts``, ``ends`` (bytes), ``doc`` (row in the block)."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        self.data, self.offsets, n = data, offsets, len(data)
        self.space = SPACES[data]
        word = ~self.space
        first, last = word.copy(), word.copy()
        if n:
            first[1:] &= self.space[:-1]
            last[:-1] &= self.space[1:]
            heads = offsets[:-1][np.diff(offsets) > 0]
            tails = offsets[1:][np.diff(offsets) > 0] - 1
            first[heads] = word[heads]
            last[tails] = word[tails]
        self.starts, self.ends = np.flatnonzero(first), np.flatnonzero(last) + 1
        #: index of the first word of each row, and one past the last word of all
        self.first = np.searchsorted(self.starts, offsets)
        self.counts = np.diff(self.first)
        self.doc = np.repeat(np.arange(len(self.counts)), self.counts)

    def __len__(self) -> int:
        return len(self.starts)

    def hashes(self, seed: int = 0) -> np.ndarray:
        return byte_hashes(self.data, self.starts, self.ends, seed)

    def windows(self, size: int) -> np.ndarray:
        """Indexes of words at which a window of ``size`` words of one text starts."""
        if len(self) < size:
            return np.zeros(0, np.int64)
        room = self.first[1:][self.doc] - np.arange(len(self))
        return np.flatnonzero(room >= size)

    def joined(self, keep: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Kept words of every row, joined by one space.

        Returns the bytes, the offsets of the rows in them, and start and end of every
        kept word in them.
        """
        at = np.arange(len(self)) if keep is None else np.flatnonzero(keep)
        doc = self.doc[at]
        spaced = np.zeros(len(at), np.int64)
        if len(at):
            spaced[:-1] = doc[1:] == doc[:-1]  # a space follows, unless it is the last kept word of its row
        length = self.ends[at] - self.starts[at]
        stop = np.cumsum(length + spaced)
        begin = stop - length - spaced
        step = np.zeros(len(self.data) + 2, np.int8)
        step[self.starts[at]] += 1
        step[self.ends[at] + spaced] -= 1
        inside = np.cumsum(step[:len(self.data)], dtype=np.int8).astype(bool)
        plain = np.where(self.space, np.uint8(0x20), self.data)[inside] if len(at) else np.zeros(0, np.uint8)
        bounds = np.concatenate([[0], stop])[np.searchsorted(doc, np.arange(len(self.counts) + 1))]
        return plain, bounds, begin, begin + length


def sliding(op: np.ufunc, x: np.ndarray, width: int) -> np.ndarray:
    """``op`` over every run of ``width`` neighbours, by doubling; shorter by ``width - 1``."""
    span, out = 1, x
    while 2 * span <= width:
        out, span = op(out[:-span], out[span:]), 2 * span
    if span < width:
        rest = width - span
        out = op(out[:-rest], out[rest:])
    return out


def per_block(fn: Callable[..., dict], schema: pa.Schema, text: str, limit: int = BLOCK_BYTES) -> Callable:
    """A ``mapInArrow`` function: ``fn(rows, data, offsets)`` gives columns for a block of rows."""
    def run(batches):
        for batch in batches:
            for first, last, data, offsets in blocks(batch.column(text), limit):
                out = fn(batch.slice(first, last - first), data, offsets)
                if out:
                    yield pa.RecordBatch.from_arrays([_as(out[f.name], f.type) for f in schema], schema=schema)
            release()
    return run


def release() -> None:
    """Give freed Arrow memory back: a worker serves many tasks, and what it keeps adds up."""
    pa.default_memory_pool().release_unused()


def _as(values, kind: pa.DataType) -> pa.Array:
    if isinstance(values, pa.ChunkedArray):
        values = values.combine_chunks()
    return values.cast(kind) if isinstance(values, pa.Array) else pa.array(values, kind)


def row_key(doc_id: str, text: str) -> list[Column]:
    """Two 64-bit columns that stand for a row; equal only for rows of equal id and text."""
    return [F.xxhash64(F.lit(1), F.col(doc_id).cast("string"), F.col(doc_id).isNull()).alias("k1"),
            F.xxhash64(F.lit(2), F.col(text), F.col(text).isNull()).alias("k2")]


def shuffle_parts(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
