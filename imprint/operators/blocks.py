"""Exact comparison of all rows of two tables, block by block.

Where a radius is so wide that any index leaves a large share of all pairs to be
tested, every pair is tested instead. The rows of either side are dealt to blocks,
and every pair of blocks is a group of its own: a row is sent once to each block it
meets, and pairs are made, tested and scored where a task has both blocks. So what
is shuffled grows with the rows and not with the pairs, and a task holds two blocks
and a strip of their pairs.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from math import ceil, sqrt
from typing import Protocol

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Rows below which a table is not divided, and rows of the largest block.
_LEAST, _MOST = 1_000, 100_000
#: Rows and columns of the part of a matrix of distances that is looked at together.
_HIGH, _WIDE = 64, 4096
#: Pairs that leave a task together.
_SENT = 1 << 16
#: Pairs whose histograms are looked at together.
_PAIRS = 1 << 11
_LOW_LONG, _HIGH_LONG = -(1 << 63), (1 << 63) - 1

Part = dict[str, pa.Array]


class Verify(Protocol):
    """A test of pairs, NULL for those that fail it, on joined rows or where a task makes them.

    ``left`` and ``right`` are the columns that it reads, which have these words in front.
    """

    left: list[str]
    right: list[str]

    def column(self) -> Column: ...

    def type(self, right: T.StructType) -> T.DataType: ...

    def arrays(self, one: pa.Table, other: pa.Table) -> Callable[[np.ndarray, np.ndarray], tuple[np.ndarray, pa.Array]]:
        """For places in both tables: which of the pairs pass, in order, and what they get."""
        ...


def block_count(df: DataFrame, rows: int) -> int:
    """Blocks of a table: pairs of them for all cores, and none of more than some 100 000 rows."""
    wanted = max(ceil(sqrt(16 * df.sparkSession.sparkContext.defaultParallelism)), ceil(rows / _MOST))
    return max(1, min(wanted, ceil(rows / _LEAST)))


def blocks_by(rows: DataFrame, by: list[str], most: int) -> DataFrame:
    """Rows with ``_blocks``, the blocks of their group: ``most`` or as many as its rows need."""
    if not by:
        return rows.withColumn("_blocks", F.lit(most))
    needed = rows.groupBy(*by).agg(F.least(F.lit(most), F.ceil(F.count(F.lit(1)) / _LEAST)).cast("int").alias("_blocks"))
    return rows.join(needed, by)


def hashed_block(*keys: str) -> Column:
    return F.pmod(F.xxhash64(*keys), F.col("_blocks")).cast("int")


def ranged_block(value: Column, cuts: list[float], most: int) -> Column:
    """Block by place among ``most - 1`` cuts, in order: a greater value is in no earlier block."""
    place = F.size(F.filter(F.array(*[F.lit(float(c)) for c in cuts]), lambda c: c < value)) if cuts else F.lit(0)
    return F.floor(place * F.col("_blocks") / most).cast("int")


def to_blocks(own: Column, first: Column, last: Column, row: bool) -> list[Column]:
    """Columns ``_row`` and ``_col`` of rows that are of one block and sent to blocks first to last."""
    met = F.explode(F.sequence(first, last))
    return [own.alias("_row"), met.alias("_col")] if row else [met.alias("_row"), own.alias("_col")]


def meet(
    left: DataFrame, right: DataFrame, by: list[str], blocks: int, schema: T.StructType,
    compare: Callable[[pa.Table, pa.Table, bool], Iterator[Part]],
) -> DataFrame:
    """What ``compare`` yields for every pair of blocks: columns of ``schema`` without those of ``by``.

    Each side has ``_row`` and ``_col``. ``compare`` also hears whether both blocks are one.
    """
    both = left.withColumn("_left", F.lit(True)).unionByName(right.withColumn("_left", F.lit(False)), allowMissingColumns=True)
    keys = [*by, "_row", "_col"]
    # A fixed number, for a few megabytes of rows are many pairs.
    dealt = both.repartition(min(20_000, max(1, blocks * blocks)), *keys)

    def run(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(list(batches)).combine_chunks()
        of_left = table.column("_left")
        sides = [table.filter(of_left), table.filter(pc.invert(of_left))]
        if not all(side.num_rows for side in sides):
            return
        for part in compare(*sides, key[-1].as_py() == key[-2].as_py()):
            size = len(next(iter(part.values())))
            columns = {**{name: pa.repeat(key[i], size) for i, name in enumerate(by)}, **part}
            yield pa.RecordBatch.from_arrays([columns[name] for name in names], names)

    names = schema.names
    return dealt.groupBy(*keys).applyInArrow(run, schema)


def _longs(column: pa.ChunkedArray, null: int = 0) -> np.ndarray:
    return pc.fill_null(column.cast(pa.int64()), null).to_numpy()


def _near(left: np.ndarray, right: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Places in both arrays of hashes within the radius, and their distances."""
    found = []
    for at in range(0, len(right), _WIDE):
        distances = np.bitwise_count(left[:, None] ^ right[None, at : at + _WIDE])
        places = np.flatnonzero(distances <= radius)
        row, column = np.divmod(places, distances.shape[1])
        found.append((row, column + at, distances.ravel()[places]))
    return tuple(np.concatenate(parts) for parts in zip(*found)) if found else (np.zeros(0, np.int64),) * 3


def _strips(starts: np.ndarray, high: int = _HIGH) -> Iterator[tuple[int, int]]:
    """Ranges of whole keys with about so many rows; ``starts`` are the first rows of the keys, and the end."""
    key, keys = 0, len(starts) - 1
    while key < keys:
        stop = max(key + 1, int(np.searchsorted(starts, starts[key] + high, "right")) - 1)
        yield key, stop
        key = stop


def _sent(parts: Iterator[tuple]) -> Iterator[tuple]:
    """Tuples of arrays, put together until they are worth a batch."""
    held, size = [], 0
    for part in parts:
        if len(part[0]):
            held.append(part)
            size += len(part[0])
        if size >= _SENT:
            yield tuple(np.concatenate(p) for p in zip(*held))
            held, size = [], 0
    if held:
        yield tuple(np.concatenate(p) for p in zip(*held))


class _Hashes:
    """Rows with a list of hashes each, as one array."""

    def __init__(self, table: pa.Table):
        lists = table.column("hashes").combine_chunks()
        self.starts = np.concatenate([[0], np.cumsum(pc.list_value_length(lists).to_numpy())])
        self.hashes = lists.flatten().to_numpy().view(np.uint64)
        self.owner = np.repeat(np.arange(len(lists)), np.diff(self.starts))


def nearest_pairs(
    left: DataFrame, right: DataFrame, radius: int, by: list[str], rows: int,
    verify: Verify | None = None, unsent: tuple[str, ...] = (),
) -> DataFrame:
    """Pairs of rows with hashes within a radius, and the least ``distance`` of theirs.

    Rows have ``hashes``, a list without NULL, and columns that begin with ``left_`` or
    ``right_`` and come with each pair, but for ``unsent`` ones. Pairs have equal ``by``
    columns. With ``verify`` only pairs that have a ``match`` are kept, and come with it.
    """
    blocks = block_count(left, rows)
    sides = []
    for side, row in ((left, True), (right, False)):
        names = [c for c in side.columns if c not in by]
        # Blocks are numbers of both sides, so they do not depend on the group.
        dealt = side.withColumn("_blocks", F.lit(blocks))
        sides.append(dealt.select(*by, *names, *to_blocks(hashed_block(*names), F.lit(0), F.lit(blocks - 1), row)))
    carried = [[f for f in side.schema.fields if f.name not in (*by, "hashes", *unsent)] for side in (left, right)]
    found = [T.StructField("distance", T.IntegerType())]
    if verify is not None:
        found.append(T.StructField("match", verify.type(right.schema)))
    schema = T.StructType([f for f in left.schema.fields if f.name in by] + carried[0] + carried[1] + found)
    left_names, right_names = ([f.name for f in fields] for fields in carried)

    def compare(one: pa.Table, other: pa.Table, same: bool) -> Iterator[Part]:
        a, b = _Hashes(one), _Hashes(other)
        columns = [one.select(left_names).combine_chunks(), other.select(right_names).combine_chunks()]
        test = None if verify is None else verify.arrays(one, other)

        def strips() -> Iterator[tuple]:
            for first, stop in _strips(a.starts):
                low = a.starts[first]
                row, column, distance = _near(a.hashes[low : a.starts[stop]], b.hashes, radius)
                row, column = a.owner[row + low], b.owner[column]
                # One number orders pairs, and each pair by its distance.
                order = np.sort((row * len(other) + column) * 128 + distance)
                pair, distance = order >> 7, order & 127
                fresh = np.ones(len(pair), bool)
                fresh[1:] = pair[1:] != pair[:-1]
                row, column = np.divmod(pair[fresh], max(1, len(other)))
                yield row, column, distance[fresh]

        for row, column, distance in _sent(strips()):
            match = {}
            if test is not None:
                kept, matches = test(row, column)
                row, column, distance, match = row[kept], column[kept], distance[kept], {"match": matches}
            part = {n: columns[0].column(n).chunk(0).take(pa.array(row)) for n in left_names}
            part |= {n: columns[1].column(n).chunk(0).take(pa.array(column)) for n in right_names}
            yield {**part, "distance": pa.array(distance.astype(np.int32)), **match}

    return meet(*sides, by, blocks, schema, compare)


class _Histograms:
    """Lists of numbers as rows of one array, shorter ones filled with zeros, and their sums."""

    def __init__(self, lists: pa.Array):
        self.length = pc.fill_null(pc.list_value_length(lists), 0).to_numpy()
        flat, most = lists.flatten(), max(1, int(self.length.max(initial=0)))
        values = pc.fill_null(flat, 0).to_numpy(zero_copy_only=False)
        if (self.length == most).all():
            self.values = values.reshape(-1, most)
        else:
            self.values = np.zeros((len(lists), most), values.dtype)
            self.values[np.arange(most)[None, :] < self.length[:, None]] = values
        self.total = self.values.sum(axis=1, dtype=np.float64)
        self.there = lists.is_valid().to_numpy(zero_copy_only=False)
        if flat.null_count:
            owner = np.repeat(np.arange(len(lists)), self.length)
            self.there[owner[flat.is_null().to_numpy(zero_copy_only=False)]] = False


def _color_distances(left: _Histograms, rows: np.ndarray, right: _Histograms, others: np.ndarray) -> np.ndarray:
    """``color.bhattacharyya`` of pairs of rows, NaN for its NULL."""
    distances = np.empty(len(rows))
    width = min(left.values.shape[1], right.values.shape[1])
    with np.errstate(all="ignore"):
        for at in range(0, len(rows), _PAIRS):
            i, j = rows[at : at + _PAIRS], others[at : at + _PAIRS]
            products = np.multiply(left.values[i, :width], right.values[j, :width], dtype=np.float64)
            overlap = np.sqrt(products, out=products).sum(axis=1)
            scale = left.total[i] * right.total[j]
            apart = np.sqrt(np.maximum(0.0, 1 - overlap / np.sqrt(scale)))
            # Histograms of two lengths have no overlap there, and greatest(0, NULL) is 0.
            apart[left.length[i] != right.length[j]] = 0.0
            apart[~(left.there[i] & right.there[j]) | (scale <= 0)] = np.nan
            distances[at : at + _PAIRS] = apart
    return distances


class BestRotations:
    """``duplicates.best_match`` on arrays: rows with a hash and a histogram against rows with prints."""

    def __init__(self, hashes: pa.ChunkedArray, colors: pa.ChunkedArray, prints: pa.ChunkedArray, structural_max: int, color_max: float):
        self.structural_max, self.color_max = structural_max, color_max
        self.asked = hashes.is_valid().to_numpy()
        self.hash, self.color = _longs(hashes).view(np.uint64), _Histograms(colors.combine_chunks())
        lists = prints.combine_chunks()
        self.count = pc.fill_null(pc.list_value_length(lists), 0).to_numpy().astype(np.int64)
        self.first = np.cumsum(self.count) - self.count
        one = lists.flatten()
        # These are NULL where the whole print is.
        fields = dict(zip((f.name for f in one.type), one.flatten()))
        self.rotations, self.colors = fields["rotation"], _Histograms(fields["color"])
        # The least of all where there is none, as in the order of structs.
        self.rotation = _longs(fields["rotation"], _LOW_LONG)
        self.there = fields["hash"].is_valid().to_numpy(zero_copy_only=False) & fields["color"].is_valid().to_numpy(zero_copy_only=False)
        self.hashes = _longs(fields["hash"]).view(np.uint64)

    def __call__(self, rows: np.ndarray, others: np.ndarray) -> tuple[np.ndarray, pa.StructArray]:
        """Which pairs of rows match, in order, and the struct of the best rotation of each."""
        many = self.count[others]
        pair = np.repeat(np.arange(len(rows)), many)
        place = np.arange(len(pair)) + np.repeat(self.first[others] - (np.cumsum(many) - many), many)
        query = rows[pair]
        distance = np.bitwise_count(self.hash[query] ^ self.hashes[place])
        kept = (distance <= self.structural_max) & self.there[place] & self.asked[query]
        pair, place, distance = pair[kept], place[kept], distance[kept]
        color = _color_distances(self.color, rows[pair], self.colors, place)
        kept = color <= self.color_max
        pair, place, distance, color = pair[kept], place[kept], distance[kept], color[kept]
        # Of several rotations of a pair the nearest is kept, then the least rotation, then the least colour.
        rotation = self.rotation[place]
        for k in range(3):
            starts = np.flatnonzero(np.diff(pair, prepend=-1))
            if len(starts) == len(pair):
                break
            value = (distance, rotation, color)[k]
            kept = value == np.repeat(np.minimum.reduceat(value, starts), np.diff(starts, append=len(pair)))
            pair, place, distance, rotation, color = pair[kept], place[kept], distance[kept], rotation[kept], color[kept]
        first = np.diff(pair, prepend=-1) != 0
        pair, place, distance, color = pair[first], place[first], distance[first], color[first]
        return pair, pa.StructArray.from_arrays(
            [pa.array(distance.astype(np.int32)), self.rotations.take(pa.array(place)), pa.array(color)], ["structural", "rotation", "color"]
        )


def near_any(left: DataFrame, right: DataFrame, radius: int, rows: int) -> DataFrame:
    """Rows of ``right`` with a ``hash`` near one of ``left``, once for every block of ``left`` that has such."""
    blocks = block_count(left, rows)
    one, other = (
        side.select("hash").withColumn("_blocks", F.lit(blocks)).select("hash", *to_blocks(hashed_block("hash"), F.lit(0), F.lit(blocks - 1), row))
        for side, row in ((left, True), (right, False))
    )

    def compare(some: pa.Table, every: pa.Table, same: bool) -> Iterator[Part]:
        a, b = (side.column("hash").to_numpy().view(np.uint64) for side in (some, every))
        apart = np.arange(len(b))
        for at in range(0, len(a), _HIGH):
            if len(apart):
                found = _near(a[at : at + _HIGH], b[apart], radius)[1]
                apart = np.delete(apart, np.unique(found))
        yield {"hash": pa.array(np.delete(b, apart).view(np.int64))}

    return meet(one, other, [], blocks, T.StructType([T.StructField("hash", T.LongType())]), compare)


class _Prints:
    """Rows of one print key and rotation each, sorted by key: hashes, colours as root shares, ids."""

    def __init__(self, table: pa.Table):
        order = pc.sort_indices(table, [("key", "ascending")])
        table = self.table = table.take(order).combine_chunks()
        codes = pc.dictionary_encode(table.column("key").combine_chunks()).indices.to_numpy()
        self.owner = codes
        self.starts = np.concatenate([np.flatnonzero(np.diff(codes, prepend=-1)), [len(codes)]])
        self.first = self.starts[:-1]
        self.hashes = table.column("hash").to_numpy().view(np.uint64)
        self.rotation = table.column("rotation").to_numpy().astype(np.int64)
        self.least, self.most = _longs(table.column("least"), _HIGH_LONG), _longs(table.column("most"), _LOW_LONG)
        self.old = pc.fill_null(table.column("old"), False).to_numpy()
        lists = table.column("color").combine_chunks()
        self.length = pc.list_value_length(lists).to_numpy()
        flat = lists.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
        roots = np.zeros((len(self.length), max(1, int(self.length.max(initial=0)))))
        roots[np.arange(roots.shape[1])[None, :] < self.length[:, None]] = flat
        with np.errstate(all="ignore"):
            total = roots.sum(axis=1)
            # An empty histogram matches nothing, and neither does one with a NULL.
            roots = np.sqrt(roots / np.where(total > 0, total, np.nan)[:, None])
        self.roots = roots

    def rows(self, first: int, stop: int, among: np.ndarray | None = None) -> np.ndarray:
        """Places of the rows of some keys."""
        low, high = self.starts[first], self.starts[stop]
        rows = np.arange(low, high)
        return rows if among is None else rows[among[low:high]]


def _scored(query: _Prints, rows: np.ndarray, other: _Prints, others: np.ndarray, radius: int, color_max: float, direction: str):
    """Matching places of ``rows`` and ``others``, with distance and colour distance."""
    i, j, distance = _near(query.hashes[rows], other.hashes[others], radius)
    i, j = rows[i], others[j]
    # Ids compare wrongly where one is missing only if nothing can be ordered: those are the extremes.
    ordered = query.most[i] > other.least[j]
    if direction == "either":
        ordered |= query.least[i] < other.most[j]
    kept = (other.old[j] | ordered) & (query.length[i] == other.length[j])
    i, j, distance = i[kept], j[kept], distance[kept]
    color = np.empty(len(i))
    width = min(query.roots.shape[1], other.roots.shape[1])
    for at in range(0, len(i), 1 << 14):
        cut = slice(at, at + (1 << 14))
        overlap = np.einsum("ij,ij->i", query.roots[i[cut], :width], other.roots[j[cut], :width])
        color[cut] = np.sqrt(np.maximum(0.0, 1 - overlap))
    kept = color <= color_max
    return i[kept], j[kept], distance[kept].astype(np.int64), color[kept]


def print_pairs(
    prints: DataFrame, rows: int, radius: int, color_max: float, direction: str, by: list[str], carried: list[str],
    history: bool = True,
) -> DataFrame:
    """Matching prints, each pair of keys once with its best (``rank``, ``color``); ``rank`` is distance * 360 + rotation.

    ``prints`` has ``key``, ``arrived``, ``least``, ``most``, ``old``, ``rotation``, ``hash`` and
    ``color``. ``carried`` columns come as ``query_`` and ``other_`` ones. Without ``history``
    no print is ``old``, and queries are sent to fewer blocks.
    """
    most = block_count(prints, rows)
    upright = F.col("arrived") & (F.col("rotation") == 0)
    later = direction == "later"
    cuts = prints.approxQuantile("least", [i / most for i in range(1, most)], 0.2 / most) if later and most > 1 else []
    dealt = blocks_by(prints.filter(F.col("hash").isNotNull() & F.col("color").isNotNull()), by, most)
    last, needed = F.col("_blocks") - 1, ["key", "least", "most", "old", "rotation", "hash", "color"]
    names = [*by, *dict.fromkeys([*needed, *carried])]
    by_hash = hashed_block("key")
    if later:
        # A query meets prints that have an id below its greatest one, and all that are old.
        left_block, right_block = ranged_block(F.col("most"), cuts, most), ranged_block(F.col("least"), cuts, most)
        left = dealt.filter(upright).select(*names, *to_blocks(left_block, F.lit(0), last if history else left_block, True))
        is_old = F.coalesce("old", F.lit(False))
        right_block = F.when(is_old, by_hash).otherwise(right_block)
        right = dealt.filter(is_old | F.col("least").isNotNull()).select(
            *names, *to_blocks(right_block, F.when(is_old, F.lit(0)).otherwise(right_block), last, False)
        )
    else:
        left = dealt.filter(upright).select(*names, *to_blocks(by_hash, F.lit(0), last, True))
        right = dealt.select(*names, *to_blocks(by_hash, F.lit(0), last, False))
    types = {f.name: f.dataType for f in prints.schema.fields}
    schema = T.StructType(
        [T.StructField(c, types[c]) for c in by] + [T.StructField(f"{s}_{c}", types[c]) for s in ("query", "other") for c in carried]
        + [T.StructField("rank", T.IntegerType()), T.StructField("color", T.DoubleType())]
    )

    def compare(one: pa.Table, two: pa.Table, same: bool) -> Iterator[Part]:
        query, other = _Prints(one), _Prints(two)
        every = np.arange(len(other.hashes))

        def strips() -> Iterator[tuple]:
            for first, stop in _strips(query.starts):
                i, j, distance, color = _scored(query, query.rows(first, stop), other, every, radius, color_max, direction)
                rank = distance * 360 + other.rotation[j]
                a, b = query.owner[i], other.owner[j]
                order = np.lexsort((color, rank, b, a))
                a, b, rank, color = a[order], b[order], rank[order], color[order]
                fresh = np.ones(len(a), bool)
                fresh[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
                yield query.first[a[fresh]], other.first[b[fresh]], rank[fresh], color[fresh]

        for i, j, rank, color in _sent(strips()):
            part = {f"query_{c}": query.table.column(c).chunk(0).take(pa.array(i)) for c in carried}
            part |= {f"other_{c}": other.table.column(c).chunk(0).take(pa.array(j)) for c in carried}
            yield {**part, "rank": pa.array(rank.astype(np.int32)), "color": pa.array(color)}

    return meet(left, right, by, most, schema, compare)


def linked_rows(prints: DataFrame, rows: int, radius: int, color_max: float, by: list[str]) -> DataFrame:
    """``key`` and ``links``: rows of the other keys that match it in either direction, and its own but one if it matches itself.

    ``prints`` as for ``print_pairs``, with ``size``, the rows of a key, and a LONG ``key``. No pair is ever a row.
    """
    most = block_count(prints, rows)
    dealt = blocks_by(prints.filter(F.col("hash").isNotNull() & F.col("color").isNotNull()), by, most)
    names = [*by, "key", "size", "arrived", "least", "most", "old", "rotation", "hash", "color"]
    own, last = hashed_block("key"), F.col("_blocks") - 1
    left = dealt.select(*names, *to_blocks(own, own, last, True))
    right = dealt.select(*names, *to_blocks(own, F.lit(0), own, False))
    schema = T.StructType(
        [f for f in prints.schema.fields if f.name in by] + [T.StructField("key", T.LongType()), T.StructField("links", T.LongType())]
    )

    def compare(one: pa.Table, two: pa.Table, same: bool) -> Iterator[Part]:
        a = _Prints(one)
        b = a if same else _Prints(two)
        upright = [side.table.column("arrived").to_numpy(zero_copy_only=False).astype(bool) & (side.rotation == 0) for side in (a, b)]
        every, queries = np.arange(len(b.hashes)), np.flatnonzero(upright[1])
        sizes = [_longs(side.table.column("size"))[side.first] for side in (a, b)]
        links = [np.zeros(len(size), np.int64) for size in sizes]
        for first, stop in _strips(a.starts):
            there = _scored(a, a.rows(first, stop, upright[0]), b, every, radius, color_max, "either")
            back = _scored(a, a.rows(first, stop), b, queries, radius, color_max, "either")
            i, j = (a.owner[np.concatenate([there[0], back[0]])], b.owner[np.concatenate([there[1], back[1]])])
            i, j = np.divmod(np.unique(i.astype(np.int64) * len(sizes[1]) + j), len(sizes[1]))
            if same:
                np.add.at(links[0], i, sizes[1][j] - (i == j))
            else:
                np.add.at(links[0], i, sizes[1][j])
                np.add.at(links[1], j, sizes[0][i])
        for side, counts in ((a, links[0]), (b, links[1]))[: 1 if same else 2]:
            kept = np.flatnonzero(counts)
            yield {"key": side.table.column("key").chunk(0).take(pa.array(side.first[kept])), "links": pa.array(counts[kept])}

    counted = meet(left, right, by, most, schema, compare)
    return counted.groupBy(*by, "key").agg(F.sum("links").alias("links"))
