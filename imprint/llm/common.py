"""Helpers shared by the text operators: byte views of Arrow columns, word scans, components."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from imprint.session import materialize

#: Lower case of the ASCII letters, byte by byte.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

#: Bytes of words between white space.
SOLID = np.ones(256, bool)
SOLID[[9, 10, 11, 12, 13, 32]] = False

#: Bytes of lower-cased words: digits, letters and everything outside ASCII.
WORDY = np.zeros(256, bool)
WORDY[48:58] = WORDY[97:123] = WORDY[128:] = True

# Arrow's own pool keeps what is freed, in each of an executor's Python workers.
pa.set_memory_pool(pa.system_memory_pool())

_SPAN = 64
_RANDOM = np.random.default_rng(1).integers(0, 2**64, (_SPAN, 256), np.uint64)
_SLICE = 1 << 20


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads all bits (the splitmix64 finaliser)."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all strings of a column, and where each begins and ends; null is empty."""
    if column.null_count:
        column = column.fill_null("")
    column = column.cast(pa.large_string())
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    bytes_ = np.frombuffer(data, np.uint8) if data is not None else np.empty(0, np.uint8)
    return bytes_[offsets[0] : offsets[-1]], offsets - offsets[0]


def slices(offsets: np.ndarray, limit: int = _SLICE) -> Iterator[tuple[int, int]]:
    """Ranges of rows with at most ``limit`` bytes, or with one row."""
    first, n = 0, len(offsets) - 1
    while first < n:
        last = max(first + 1, int(np.searchsorted(offsets, offsets[first] + limit, "right")) - 1)
        yield first, last
        first = last


class Words:
    """Words of a few texts: the text, begin and end (bytes) and 64-bit hash of each."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, table: np.ndarray):
        """``offsets`` are those of the texts within ``data``; ``table`` says which bytes are in words."""
        parts, at, size = [], 0, len(data)
        while at < size:
            end = min(at + _SLICE, size)
            while end < size and table[data[end]]:  # a cut never divides a word
                beyond = ~table[data[end : end + 65536]]
                end += int(beyond.argmax()) if beyond.any() else len(beyond)
            parts.append(self._scan(data, offsets, table, at, end))
            at = end
        none = np.empty(0, np.int64)
        self.start, self.end, self.hash = (
            (np.concatenate(x) if len(x) > 1 else x[0]) for x in zip(*(parts or [(none, none, none.astype(np.uint64))]))
        )
        self.data, self.offsets = data, offsets
        self.text = np.searchsorted(offsets, self.start, "right") - 1
        #: First word of each text, and the number of all words.
        self.first = np.searchsorted(self.start, offsets)

    @staticmethod
    def _scan(data, offsets, table, at, end):
        inside = table[data[at:end]]
        border = offsets[(offsets >= at) & (offsets < end)] - at
        opens = inside.copy()
        opens[1:] &= ~inside[:-1]
        opens[border] = inside[border]
        closes = inside.copy()
        closes[:-1] &= ~inside[1:]
        last = border[border > 0] - 1
        closes[last] = inside[last]
        start, stop = np.flatnonzero(opens), np.flatnonzero(closes) + 1
        where = np.flatnonzero(inside)
        size = stop - start
        ends = np.cumsum(size)
        offset = np.arange(len(where)) - np.repeat(ends - size, size)
        value = _RANDOM.reshape(-1)[((offset % _SPAN) << 8) | data[at:end][where]]
        if len(size) and size.max() > _SPAN:
            value *= (2 * (offset // _SPAN) + 1).astype(np.uint64)
        total = np.zeros(len(where) + 1, np.uint64)
        np.cumsum(value, out=total[1:])
        return start + at, stop + at, mix(total[ends] - total[ends - size] + size.astype(np.uint64))

    def windows(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        """First words of all runs of ``n`` words within one text, and hashes of the runs."""
        count = max(0, len(self.hash) - n + 1)
        value = np.zeros(count, np.uint64)
        for k in range(n):
            value = value * np.uint64(0x9E3779B97F4A7C15) + self.hash[k : k + count]
        begin = np.flatnonzero(self.text[:count] == self.text[n - 1 : n - 1 + count])
        return begin, mix(value[begin])


def word_slices(column: pa.Array, table: np.ndarray, lower: bool) -> Iterator[tuple[int, int, Words]]:
    """(first row, last row, words) of a column of texts, a few MB at a time."""
    data, offsets = utf8(column)
    for first, last in slices(offsets):
        piece = data[offsets[first] : offsets[last]]
        yield first, last, Words(LOWER[piece] if lower else piece, offsets[first : last + 1] - offsets[first], table)


def batch(**columns) -> pa.RecordBatch:
    """A record batch of named columns."""
    return pa.RecordBatch.from_arrays(
        [c if isinstance(c, pa.Array) else pa.array(c) for c in columns.values()], names=list(columns)
    )


@contextmanager
def small_batches(spark: SparkSession, rows: int = 500) -> Iterator[None]:
    """Arrow batches of fewer rows for the jobs run inside, where rows are whole texts or sets."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, rows)
    try:
        yield
    finally:
        spark.conf.set(name, before)


def _stars(edges: DataFrame) -> bool:
    """Does every node hang on one root that hangs on nothing?"""
    ends = edges.select("a", F.lit(1).alias("up"), F.lit(0).alias("down")).union(edges.select("b", F.lit(0), F.lit(1)))
    nodes = ends.groupBy("a").agg(F.sum("up").alias("up"), F.max("down").alias("down"))
    return nodes.agg(F.coalesce(F.bool_or((F.col("up") > 1) | (F.col("up") * F.col("down") > 0)), F.lit(False))).first()[0] is False


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for all nodes of ``edges`` (a, b); the root is the smallest node reachable.

    Alternates between giving each node's larger neighbours and its smaller ones
    to its smallest neighbour until nothing changes. Each round is two partial
    aggregations and two joins over written tables, so a lost executor costs no
    more than the running round, and a hub's rows are reduced before they move.
    Copies of an edge within a round do no harm; they go when it is written.
    """
    now = materialize(
        edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    )
    while not _stars(now):
        both = now.union(now.select("b", "a"))
        least = both.groupBy("a").agg(F.min("b").alias("m")).withColumn("m", F.least("a", "m"))
        large = both.filter("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        # Smaller neighbours and the node itself go to the smallest one, which goes nowhere.
        moved = F.explode(F.array(F.struct(F.col("b").alias("a"), F.col("m").alias("b")), F.struct("a", F.col("m").alias("b"))))
        now = materialize(large.join(least, "a").select(moved.alias("e")).select("e.a", "e.b").filter("a <> b").distinct())
    members = now.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return members.union(now.select(F.col("b"), F.col("b")).distinct())
