"""Benchmark decontamination by multi-pattern search over words (Wu and Manber's method).

Patterns are runs of words of benchmark items. For each pattern length there is a
table of shifts by block (the last two words read): the distance by which the
search may go on without passing over a pattern. Where it is zero, the hash of
the block names the patterns that end so, and their words are compared directly.
The texts of a batch are searched in many lanes at once, each a stretch of words.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from imprint.llm.common import WORDY, Words, batch, word_slices

_LANE = 256
_C1, _C2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


class Patterns:
    """Patterns of one length with their shift table and suffix buckets."""

    def __init__(self, length: int, runs: dict[bytes, list[int]]):
        """``runs`` maps a pattern (words joined by a space) to the numbers of its items."""
        self.length, self.block = length, min(2, length)
        self.words = list(runs)
        self.items = [np.unique(v) for v in runs.values()]
        joined = np.frombuffer(b" ".join(self.words), np.uint8)
        self.hash = Words(joined, np.array([0, len(joined)]), WORDY).hash.reshape(len(self.words), length)
        self.bits = int(np.clip(np.ceil(np.log2(len(runs) * length)) + 4, 12, 22))
        self.shift = np.full(1 << self.bits, length - self.block + 1, np.int64)
        for j in range(self.block - 1, length):
            block = self._blocks(self.hash[:, j - 1] if self.block == 2 else None, self.hash[:, j])
            np.minimum.at(self.shift, self._slot(block), length - 1 - j)
        last = self._blocks(self.hash[:, -2] if self.block == 2 else None, self.hash[:, -1])
        self.order = np.argsort(last, kind="stable")
        self.suffix = last[self.order]

    def _blocks(self, before, last):
        return last * _C2 if before is None else before * _C1 + last * _C2

    def _slot(self, block):
        return (block >> np.uint64(64 - self.bits)).astype(np.int64)

    def search(self, words: Words) -> tuple[np.ndarray, np.ndarray]:
        """(first word, pattern) of every occurrence."""
        h, m, n = words.hash, self.length, len(words.hash)
        at = np.arange(m - 1, n, _LANE)
        stop = np.minimum(at + _LANE, n)
        found = []
        while len(at):
            shift = self.shift[self._slot(self._blocks(h[at - 1] if self.block == 2 else None, h[at]))]
            found.append(at[shift == 0])
            at = at + np.maximum(shift, 1)
            live = at < stop
            at, stop = at[live], stop[live]
        ends = np.concatenate(found) if found else np.empty(0, np.int64)
        block = self._blocks(h[ends - 1] if self.block == 2 else None, h[ends])
        low, high = np.searchsorted(self.suffix, block, "left"), np.searchsorted(self.suffix, block, "right")
        count = high - low
        begin = np.repeat(ends, count) - m + 1
        rank = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count) + np.repeat(low, count)
        pattern = self.order[rank]
        ok = words.text[begin] == words.text[begin + m - 1]
        for k in range(m):
            ok[ok] = h[begin[ok] + k] == self.hash[pattern[ok], k]
        keep = [i for i in np.flatnonzero(ok) if self._equal(words, begin[i], pattern[i])]
        return begin[keep], pattern[keep]

    def _equal(self, words: Words, begin: int, pattern: int) -> bool:
        data = words.data
        return self.words[pattern] == b" ".join(
            data[words.start[k] : words.end[k]].tobytes() for k in range(begin, begin + self.length)
        )


def item_patterns(texts: list[str | None], window: int) -> list[Patterns]:
    """Patterns of all windows of the items; an item of fewer words is one window."""
    runs: dict[int, dict[bytes, list[int]]] = defaultdict(lambda: defaultdict(list))
    for first, last, words in word_slices(pa.array(texts, pa.string()), WORDY, lower=True):
        tokens = [words.data[a:b].tobytes() for a, b in zip(words.start, words.end)]
        for i in range(first, last):
            own = tokens[words.first[i - first] : words.first[i - first + 1]]
            size = min(window, len(own))
            for k in range(len(own) - size + 1 if own else 0):
                runs[size][b" ".join(own[k : k + size])].append(i)
    return [Patterns(size, found) for size, found in sorted(runs.items())]


def _blocks_of(benchmark: DataFrame, item_col: str, text_col: str, block_bytes: int) -> Iterator[tuple[list, list]]:
    """Items in blocks of about ``block_bytes`` of text, so that what is sent to tasks is bounded."""
    items = benchmark.select(F.col(item_col).alias("item"), F.col(text_col).alias("text")).filter("text is not null")
    total = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    count = max(1, -(-total // block_bytes))
    for k in range(count):
        rows = items.filter(F.pmod(F.xxhash64("item", "text"), F.lit(count)) == k).collect()
        yield [r.item for r in rows], [r.text for r in rows]


def find_contamination(
    docs: DataFrame,
    benchmark: DataFrame,
    window: int = 10,
    block_bytes: int = 8 << 20,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
) -> DataFrame:
    """Per document: words, words inside occurrences of benchmark windows, and the items that occur.

    Returns doc_id, n_words, n_hit, hits (array of [first, end) word positions,
    merged) and items (distinct item ids as strings, sorted as strings). Words
    are runs of digits, letters and characters outside ASCII, A-Z lower-cased.

    The documents are only scanned, never shuffled, as long as the benchmark fits
    one block of ``block_bytes``; each further block is one more scan, and the
    results are joined per document.

    Null or empty text has no words and no hits. Null items and items without
    words are skipped; items with equal windows all count. An empty benchmark
    hits nothing. Rows that repeat an id are judged one by one. Other columns
    are ignored, whatever their names.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    kinds = dict(rows.dtypes)
    schema = f"doc_id {kinds['doc_id']}, key bigint, n_words bigint, hits array<struct<first:bigint,stop:bigint>>, items array<string>"
    rows = rows.withColumn("key", F.xxhash64("text"))
    found, blocks = [], 0
    for names, texts in _blocks_of(benchmark, item_col, item_text_col, block_bytes):
        found.append(rows.mapInArrow(_searcher(item_patterns(texts, window), [str(n) for n in names]), schema))
        blocks += 1
    if blocks == 1:
        hits = found[0]
    else:
        every = found[0]
        for more in found[1:]:
            every = every.union(more)
        hits = (
            every.groupBy("doc_id", "key", "n_words")
            .agg(
                F.array_sort(F.array_distinct(F.flatten(F.collect_list("hits")))).alias("hits"),
                F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"),
                (F.count(F.lit(1)) / blocks).cast("int").alias("copies"),
            )
            .withColumn("copies", F.explode(F.sequence(F.lit(1), F.col("copies"))))
            .drop("copies")
            .mapInArrow(_merge, schema)
        )
    n_hit = F.aggregate("hits", F.lit(0).cast("bigint"), lambda a, x: a + x["stop"] - x["first"])
    return hits.select("doc_id", "n_words", n_hit.alias("n_hit"), "hits", "items")


_HITS = pa.list_(pa.struct([("first", pa.int64()), ("stop", pa.int64())]))


def _runs(spans: list[tuple[int, int]]) -> list[dict]:
    """Union of [first, stop) spans."""
    out: list[dict] = []
    for a, b in sorted(spans):
        if out and a <= out[-1]["stop"]:
            out[-1]["stop"] = max(out[-1]["stop"], b)
        else:
            out.append({"first": a, "stop": b})
    return out


def _merge(batches):
    for b in batches:
        hits = [_runs([(x["first"], x["stop"]) for x in row]) for row in b.column("hits").to_pylist()]
        yield b.set_column(b.schema.get_field_index("hits"), "hits", pa.array(hits, _HITS))


def _searcher(patterns: list[Patterns], names: list[str]):
    def search(batches):
        for b in batches:
            n = b.num_rows
            counts = np.zeros(n, np.int64)
            spans, items = [[] for _ in range(n)], [set() for _ in range(n)]
            for first, last, words in word_slices(b.column("text"), WORDY, lower=True):
                counts[first:last] = np.diff(words.first)
                for p in patterns:
                    for at, k in zip(*(x.tolist() for x in p.search(words))):
                        row = words.text[at]
                        begin = at - int(words.first[row])
                        spans[first + row].append((begin, begin + p.length))
                        items[first + row].update(p.items[k].tolist())
            yield batch(
                doc_id=b.column("doc_id"),
                key=b.column("key"),
                n_words=counts,
                hits=pa.array([_runs(x) for x in spans], _HITS),
                items=pa.array([sorted({names[i] for i in x}) for x in items], pa.list_(pa.string())),
            )

    return search



def keep_clean(
    docs: DataFrame, benchmark: DataFrame, window: int = 10, block_bytes: int = 8 << 20, text_col: str = "text",
    item_col: str = "item_id", item_text_col: str = "text",
) -> DataFrame:
    """Rows of ``docs``, all columns kept, in whose text no benchmark window occurs.

    As :func:`find_contamination`; each further block of the benchmark looks
    through what the ones before it left.
    """

    def cleaner(patterns):
        def run(batches):
            for b in batches:
                keep = np.ones(b.num_rows, bool)
                for first, _, words in word_slices(b.column(b.schema.get_field_index(text_col)), WORDY, lower=True):
                    for p in patterns:
                        keep[first + words.text[p.search(words)[0]]] = False
                yield b.filter(pa.array(keep))

        return run

    for _, texts in _blocks_of(benchmark, item_col, item_text_col, block_bytes):
        docs = docs.mapInArrow(cleaner(item_patterns(texts, window)), docs.schema)
    return docs
