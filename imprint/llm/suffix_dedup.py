"""Removal of repeated byte strings by a distributed merge sort of suffixes.

A byte goes if a string of ``length`` bytes that covers it also starts earlier.
Sorting every suffix would move each byte a hundred times, so suffixes start at
anchors only: the anchor of a string is its k-gram with the least hash, hence
equal strings have equal anchors at equal places. Strings that start next to one
another mostly share their anchor; they form the anchor's span, and all spans of
a text together hold each of its strings once.

1. Spans are listed by anchor. Among equal spans only the first stays; the others
   go whole. This settles the inside of every repeated passage.
2. Where different spans share an anchor, some of their strings may be equal. They
   are sorted as suffixes from the anchor on: each task exports a sorted run,
   front-coded (common prefix with its predecessor and the remainder), and the
   runs of a range are merged by a loser tree which keeps with each loser its
   common prefix with the winner, so known bytes are never compared again. In the
   merged order the spans of one anchor are neighbours, and so equal strings meet.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from imprint.llm.common import batch, mix, slices, utf8
from imprint.session import materialize

#: Bytes of an anchor.
GRAM = 32
#: Spans of one anchor above which its strings are dealt out one by one.
HOT = 5_000
_BITS = np.uint64(24)
_PLACE = np.uint64((1 << 24) - 1)
_PIECE = 4 << 20
_ODD = np.uint64(0x9E3779B97F4A7C15)


def _inverse(x: int) -> int:
    return pow(x, -1, 1 << 64)


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n + 1, base, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


class _Hasher:
    """Hashes of all stretches of a piece of text from one running sum."""

    def __init__(self, size: int):
        self.power = _powers(int(_ODD), size)
        self.back = _powers(_inverse(int(_ODD)), size)

    def sums(self, data: np.ndarray) -> np.ndarray:
        out = np.zeros(len(data) + 1, np.uint64)
        np.cumsum((data.astype(np.uint64) + np.uint64(1)) * self.power[: len(data)], out=out[1:])
        return out


def _sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    step = 1
    while step * 2 <= width:
        x = np.minimum(x[:-step], x[step:])
        step *= 2
    return np.minimum(x[: len(x) - (width - step)], x[width - step :]) if width > step else x


def spans_of(data: np.ndarray, length: int, hasher: _Hasher):
    """Spans of one stretch of text: begin and end of the starts of its strings, anchor, two hashes."""
    n = len(data) - length + 1
    sums = hasher.sums(data)
    count = len(data) - GRAM + 1
    grams = mix((sums[GRAM:] - sums[:-GRAM]) * hasher.back[:count])
    packed = (grams & ~_PLACE) | np.arange(count, dtype=np.uint64)
    anchor = (_sliding_min(packed, length - GRAM + 1) & _PLACE).astype(np.int64)[:n]
    first = np.flatnonzero(np.concatenate([[True], anchor[1:] != anchor[:-1]]))
    stop = np.append(first[1:], n)
    anchor = anchor[first]
    ends = stop - 1 + length
    content = mix((sums[ends] - sums[first]) * hasher.back[first] + ((anchor - first) * 4096 + (ends - first)).astype(np.uint64))
    return first, stop, anchor, grams[anchor], content


def _pieces(size: int, length: int):
    """Stretches of a long text whose strings of ``length`` bytes are all of its own, each once."""
    at = 0
    while at + length <= size:
        end = min(size, at + _PIECE + length - 1)
        yield at, end
        at = end - length + 1


def _later_copies(rank: np.ndarray, first: np.ndarray, gram: np.ndarray, content: np.ndarray) -> np.ndarray:
    """Which spans have an equal one earlier among these?"""
    order = np.lexsort((first, rank, content, gram))
    fresh = np.ones(len(order), bool)
    fresh[1:] = (gram[order][1:] != gram[order][:-1]) | (content[order][1:] != content[order][:-1])
    head = order[np.maximum.accumulate(np.where(fresh, np.arange(len(order)), 0))]
    out = np.zeros(len(order), bool)
    out[order] = (rank[head] != rank[order]) | (first[head] != first[order])
    return out


def _text_ranks(ids: pa.Array, digests: pa.Array) -> np.ndarray:
    """Dense ranks of texts by id, null first, and then by digest."""
    by_id = pc.rank(ids, sort_keys="ascending", null_placement="at_start", tiebreaker="dense").to_numpy().astype(np.int64)
    by_digest = digests.to_numpy().astype(np.int64)
    order = np.lexsort((by_digest, by_id))
    new = np.ones(len(order), bool)
    new[1:] = (by_id[order][1:] != by_id[order][:-1]) | (by_digest[order][1:] != by_digest[order][:-1])
    out = np.empty(len(order), np.int64)
    out[order] = np.cumsum(new)
    return out


def _list_spans(length: int):
    def run(batches):
        hasher = _Hasher(_PIECE + length)
        for b in batches:
            data, offsets = utf8(b.column("text"))
            ids, digests = b.column("doc_id"), b.column("digest")
            rank = _text_ranks(ids, digests)
            for lo, hi in slices(offsets, 16 << 20):
                found = []
                for i in range(lo, hi):
                    text = data[offsets[i] : offsets[i + 1]]
                    for at, end in _pieces(len(text), length):
                        first, stop, anchor, gram, content = spans_of(text[at:end], length, hasher)
                        found.append((np.full(len(first), i), first + at, (stop - first) | ((anchor - first) << 8), gram, content))
                if found:
                    row, first, shape, gram, content = (np.concatenate(x) for x in zip(*found))
                    later = _later_copies(rank[row], first, gram, content)
                    # A span known to be a later copy needs no comparison: it goes to a place of its own.
                    gram[later] = mix(gram[later] ^ mix(rank[row[later]].astype(np.uint64) << np.uint64(40) ^ first[later].astype(np.uint64)))
                    yield batch(
                        gram=gram.view(np.int64), content=content.view(np.int64), doc_id=ids.take(pa.array(row)),
                        digest=digests.take(pa.array(row)), first=first, shape=shape.astype(np.int32), copy=later,
                    )

    return run


def front_code(strings: list[bytes]) -> tuple[list[int], list[bytes]]:
    """Common prefix with the string before, and the rest, of sorted strings."""
    common, rest, before = [], [], b""
    for s in strings:
        n = _common(before, s, 0)
        common.append(n)
        rest.append(s[n:])
        before = s
    return common, rest


def _common(a: bytes, b: bytes, known: int) -> int:
    """Length of the common prefix, of which ``known`` bytes are known."""
    n = min(len(a), len(b))
    if a[known:n] == b[known:n]:
        return n
    lo, hi = known, n
    while hi - lo > 1:
        mid = (lo + hi) // 2
        if a[lo:mid] == b[lo:mid]:
            lo = mid
        else:
            hi = mid
    return lo if a[lo : lo + 1] != b[lo : lo + 1] else lo + 1


class LoserTree:
    """Merges sorted front-coded runs; yields (common prefix with the one before, string, payload).

    ``seen[r]`` is the common prefix of run ``r``'s head with the last winner it
    lost to. Of two heads the one with the longer is smaller; only at a tie are
    bytes compared, from that place on.
    """

    def __init__(self, runs):
        self.runs = [iter(r) for r in runs]
        self.size = max(1, 1 << (len(self.runs) - 1).bit_length()) if self.runs else 1
        self.head: list = [None] * self.size
        self.seen = [0] * self.size
        for r in range(len(self.runs)):
            self._advance(r)
        self.loser = [-1] * self.size
        self.top = self._first(1)

    def _advance(self, r: int) -> None:
        item = next(self.runs[r], None)
        if item is None:
            self.head[r] = None
        else:
            common, rest, payload = item
            before = self.head[r][0] if self.head[r] else b""
            self.head[r] = (before[:common] + rest, payload)
            self.seen[r] = common

    def _first(self, node: int) -> int:
        if node >= self.size:
            return node - self.size
        return self._play(node, self._first(2 * node), self._first(2 * node + 1))

    def _play(self, node: int, a: int, b: int) -> int:
        """The winner of two heads goes on, the loser stays at ``node``."""
        if self.head[b] is None:
            winner, loser = a, b
        elif self.head[a] is None:
            winner, loser = b, a
        elif self.seen[a] != self.seen[b]:
            winner, loser = (a, b) if self.seen[a] > self.seen[b] else (b, a)
        else:
            x, y = self.head[a][0], self.head[b][0]
            n = _common(x, y, self.seen[a])
            less = x[n : n + 1] < y[n : n + 1] or (x[n : n + 1] == y[n : n + 1] and a < b)
            winner, loser = (a, b) if less else (b, a)
            self.seen[loser] = n
        self.loser[node] = loser
        return winner

    def __iter__(self):
        while self.head[self.top] is not None:
            r = self.top
            yield self.seen[r], *self.head[r]
            self._advance(r)
            node = (r + self.size) // 2
            while node:
                r = self._play(node, r, self.loser[node])
                node //= 2
            self.top = r


def _export_runs(length: int, ranges: int):
    """Per task and range one sorted run of the spans asked for: suffix from the anchor on, what precedes it, place."""

    def run(batches):
        for b in batches:
            data, offsets = utf8(b.column("text"))
            runs: dict[int, list] = {}
            texts = zip(b.column("doc_id").to_pylist(), b.column("digest").to_pylist())
            for i, (doc, wanted) in enumerate(zip(texts, b.column("wanted").to_pylist())):
                text = data[offsets[i] : offsets[i + 1]].tobytes()
                for w in wanted:
                    first, count, lead = w["first"], w["shape"] & 255, w["shape"] >> 8
                    anchor = first + lead
                    # A span of a hot anchor is dealt out string by string.
                    each = range(count) if w["hot"] else [None]
                    for k in each:
                        start, n = (first, count) if k is None else (first + k, 1)
                        stop = start + n - 1 + length
                        if k is None:
                            where = w["gram"] % ranges
                        else:
                            where = int.from_bytes(hashlib.blake2b(text[start:stop], digest_size=8).digest(), "little") % ranges
                        runs.setdefault(where, []).append((text[anchor:stop], text[start:anchor], doc, start, n))
            rows = []
            for where, spans in runs.items():
                spans.sort(key=lambda x: x[:2])
                common, rest = front_code([s[0] for s in spans])
                rows.append({
                    "range": where, "common": common, "rest": rest, "before": [s[1] for s in spans],
                    "doc_id": [s[2][0] for s in spans], "digest": [s[2][1] for s in spans], "first": [s[3] for s in spans], "count": [s[4] for s in spans],
                })
            yield pa.RecordBatch.from_pylist(rows, schema=_run_schema(b.schema.field("doc_id").type))

    return run


def _run_schema(kind: pa.DataType) -> pa.Schema:
    return pa.schema([
        ("range", pa.int64()), ("common", pa.list_(pa.int32())), ("rest", pa.list_(pa.binary())),
        ("before", pa.list_(pa.binary())), ("doc_id", pa.list_(kind)), ("digest", pa.list_(pa.int64())), ("first", pa.list_(pa.int64())),
        ("count", pa.list_(pa.int32())),
    ])


def _order(doc) -> tuple:
    """Sort key of texts (id, digest) in which null ids come first."""
    return (False, doc[1]) if doc[0] is None else (True, *doc)


def _repeats(spans: list[tuple[bytes, bytes, object, int, int]], length: int):
    """(doc, start) of every string of spans with one anchor that also starts earlier."""
    least: dict[tuple[int, bytes], tuple] = {}
    strings = []
    for suffix, before, doc, first, count in spans:
        text = before + suffix
        for k in range(count):
            key = (len(before) - k, text[k : k + length])
            place = (_order(doc), first + k)
            strings.append((key, place, doc))
            known = least.get(key)
            if known is None or place < known:
                least[key] = place
    for key, place, doc in strings:
        if place > least[key]:
            yield doc, place[1]


def _merge_runs(length: int):
    def run(table: pa.Table) -> pa.Table:
        runs = [
            list(zip(r["common"], r["rest"], zip(r["before"], zip(r["doc_id"], r["digest"]), r["first"], r["count"])))
            for r in table.to_pylist()
        ]
        found, group = [], []
        for common, suffix, payload in LoserTree(runs):
            if common < GRAM:
                if len(group) > 1:
                    found += _repeats(group, length)
                group = []
            group.append((suffix, *payload))
        if len(group) > 1:
            found += _repeats(group, length)
        found.sort(key=lambda x: (_order(x[0]), x[1]))
        out: list[list] = []
        for doc, start in found:
            if out and out[-1][0] == doc and start <= out[-1][2]:
                out[-1][2] = start + length
            else:
                out.append([doc, start, start + length])
        kind = table.schema.field("doc_id").type.value_type
        schema = pa.schema([("doc_id", kind), ("digest", pa.int64()), ("begin", pa.int64()), ("stop", pa.int64())])
        return pa.table([[x[0][0] for x in out], [x[0][1] for x in out], [x[1] for x in out], [x[2] for x in out]], schema=schema)

    return run


def _keep(batches):
    for b in batches:
        data, offsets = utf8(b.column("text"))
        removed, runs, digests = [], [], []
        for i, gone in enumerate(b.column("gone").to_pylist()):
            text = data[offsets[i] : offsets[i + 1]]
            spans: list[list[int]] = []
            for x in sorted((x["begin"], x["stop"]) for x in gone or ()):
                if spans and x[0] <= spans[-1][1]:
                    spans[-1][1] = max(spans[-1][1], x[1])
                else:
                    spans.append(list(x))
            keep = np.ones(len(text), bool)
            for a, z in spans:
                keep[a:z] = False
            removed.append(len(text) - int(keep.sum()))
            runs.append([{"begin": a, "stop": z} for a, z in spans])
            digests.append(text[keep].tobytes())
        yield batch(
            doc_id=b.column("doc_id"),
            n_bytes=np.diff(offsets),
            n_removed=np.array(removed, np.int64),
            removed=pa.array(runs, pa.list_(pa.struct([("begin", pa.int64()), ("stop", pa.int64())]))),
            kept=pa.array(digests, pa.binary()),
        )


def remove_repeats(
    docs: DataFrame,
    length: int = 100,
    hot: int = HOT,
    ranges: int | None = None,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """Texts without the bytes of strings that start earlier: doc_id, n_bytes, n_removed, removed, kept.

    Removes each byte covered by a ``length``-byte string that also starts at a
    smaller (id, start). Strings are judged on the input and never cross texts;
    ``removed`` has the maximal removed runs [begin, stop), ``kept`` the remaining
    bytes (which may end inside a character).

    Null text is empty, and texts shorter than ``length`` stay whole. Texts are told
    apart by id and a 64-bit digest, and those of one id stand in the order of their
    digests; rows that repeat an id and its text are one place, so none of them goes
    because of the other, and all come back. Null ids come before all others. Other
    columns are ignored.

    Moves once: the spans (about 48 bytes for every 35 of text; up to one a byte where
    text repeats itself), the texts that
    lose or compare something, and the front-coded suffixes at the borders of
    repeated passages. ``ranges`` is the number of merges, by default as many as
    shuffle partitions.
    """
    if not GRAM < length <= 255:
        raise ValueError(f"length must be from {GRAM + 1} to 255")
    spark = docs.sparkSession
    text = F.coalesce(F.col(text_col), F.lit(""))
    texts = docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(text).alias("digest"), text.alias("text"))
    kind = dict(texts.dtypes)["doc_id"]
    ranges = ranges or int(spark.conf.get("spark.sql.shuffle.partitions"))
    spans = texts.mapInArrow(_list_spans(length), f"gram bigint, content bigint, doc_id {kind}, digest bigint, first bigint, shape int, copy boolean")
    # One exchange by anchor serves all of this: equal spans, then anchors of several spans.
    equal = Window.partitionBy("gram", "content").orderBy(F.col("doc_id").asc_nulls_first(), "digest", "first")
    nth = spans.repartition("gram").withColumn("lead", F.first(F.struct("doc_id", "digest", "first")).over(equal))
    same = F.col("lead.doc_id").eqNullSafe(F.col("doc_id")) & (F.col("lead.digest") == F.col("digest")) & (F.col("lead.first") == F.col("first"))
    later = F.col("copy") | ~same
    one = Window.partitionBy("gram")
    marked = materialize(
        nth.withColumn("later", later)
        .withColumn("mixed", F.min("content").over(one) != F.max("content").over(one))
        .filter("later OR mixed")
        .select("gram", "doc_id", "digest", "first", "shape", "later")
    )
    counts = marked.filter("NOT later").groupBy("gram").count().filter(F.col("count") > hot).select("gram", F.lit(True).alias("hot"))
    border = marked.filter("NOT later").join(counts, "gram", "left").withColumn("hot", F.coalesce("hot", F.lit(False)))
    per_text = border.groupBy("doc_id", "digest").agg(
        F.collect_list(F.struct(F.abs("gram").alias("gram"), "first", "shape", "hot")).alias("wanted")
    )
    runs = (
        texts.join(per_text, texts.doc_id.eqNullSafe(per_text.doc_id) & (texts.digest == per_text.digest))
        .select(texts.doc_id, texts.digest, "text", "wanted")
        .mapInArrow(_export_runs(length, ranges), _spark_schema(kind))
    )
    merged = runs.groupBy("range").applyInArrow(_merge_runs(length), f"doc_id {kind}, digest bigint, begin bigint, stop bigint")
    whole = marked.filter("later").select(
        "doc_id", "digest", F.col("first").alias("begin"),
        (F.col("first") + F.col("shape").bitwiseAND(255) - 1 + length).alias("stop"),
    )
    gone = whole.union(merged).groupBy("doc_id", "digest").agg(F.collect_list(F.struct("begin", "stop")).alias("gone"))
    return (
        texts.join(gone, texts.doc_id.eqNullSafe(gone.doc_id) & (texts.digest == gone.digest), "left").select(texts.doc_id, "text", "gone")
        .mapInArrow(_keep, f"doc_id {kind}, n_bytes bigint, n_removed bigint, removed array<struct<begin:bigint,stop:bigint>>, kept binary")
    )


def _spark_schema(kind: str) -> str:
    return (
        f"range bigint, common array<int>, rest array<binary>, before array<binary>, doc_id array<{kind}>, digest array<bigint>, "
        "first array<bigint>, count array<int>"
    )
