"""Similarity joins over 64-bit hashes."""

from __future__ import annotations

from collections.abc import Callable
from math import ceil

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from imprint.functions.bits import hamming
from imprint.operators.bands import BandPlan
from imprint.operators.blocks import Verify, near_any, nearest_pairs
from imprint.operators.skew import assign_chunk, chunked_join, hot_keys, visit_chunks
from imprint.session import materialize

_BROADCAST_ROWS = 1_000_000  # probe or index rows of about 32 bytes
_TASK_WORK = 200_000  # probe rows, and pair tests by tens, per task
_TASK_PAIRS = 4_000_000  # pairs of rows that a task makes from pairs of values
_GROUP = 1_000  # rows of one value that are sent together
_CELL_COST = 0.1  # of a pair among all, which is tested in an array, to one that met in a band


def _constants(values: list[int], kind: str) -> str:
    """SQL array of constants that the optimiser folds to a single literal."""
    return f"cast(split('{','.join(map(str, values))}', ',') as array<{kind}>)"


def _by_band(plan: BandPlan, value: Callable[[int], str], band: str = "band") -> str:
    return f"case {band} " + " ".join(f"when {i} then {value(i)}" for i in plan.used) + " end"


def _long(value: int) -> str:
    return f"cast('{value}' as bigint)"


def _index_rows(hashes: DataFrame, plan: BandPlan, by: list[str]) -> DataFrame:
    """One row per hash and band."""
    masks = _by_band(plan, lambda i: _long(plan.mask(i)))
    banded = hashes.selectExpr(*by, "hash", f"explode({_constants(plan.used, 'int')}) as band")
    return banded.selectExpr(*by, "hash as right_hash", "band", f"hash & {masks} as key")


def _probe_rows(hashes: DataFrame, plan: BandPlan, by: list[str], symmetric: bool = False) -> DataFrame:
    """One row per hash, band and band value within the band's limit.

    ``symmetric`` leaves out band values below the hash's own: the hash that has such
    a value looks for this one. ``straight`` rows have their own band value.
    """
    flips: list[int] = []
    band = "case "
    for i in plan.used:
        flips += plan.flips(i)
        band += f"when at < {len(flips)} then {i} "
    masks = _by_band(plan, lambda i: _long(plan.mask(i)))
    probes = hashes.selectExpr(
        *by, "hash", f"posexplode({_constants(flips, 'bigint')}) as (at, flip)"
    ).selectExpr(*by, "hash", "flip", f"{band} end as band")
    if not symmetric:
        return probes.selectExpr(*by, "hash as left_hash", "band", f"(hash ^ flip) & {masks} as key")
    probes = probes.selectExpr(*by, "hash as left_hash", "band", f"(hash ^ flip) & {masks} as key", f"hash & {masks} as own")
    return probes.filter("key >= own").selectExpr(*by, "left_hash", "band", "key", "key = own as straight")


def _first_band(plan: BandPlan) -> Column:
    """True in the lowest band within its limit: each pair is kept once."""

    def no_earlier(i: int) -> str:
        clear = [
            f"bit_count((left_hash ^ right_hash) & {_long(plan.mask(j))}) > {plan.limits[j]}"
            for j in plan.used
            if j < i
        ]
        return "(" + (" and ".join(clear) or "true") + ")"

    return F.expr(_by_band(plan, no_earlier, "p.band"))


def hash_pairs(
    left: DataFrame,
    right: DataFrame,
    radius: int,
    *,
    by: list[str] | None = None,
    plan: BandPlan | None = None,
    sizes: tuple[int, int] | None = None,
    split_rows: int = 200_000,
    symmetric: bool = False,
) -> DataFrame:
    """Pairs of different rows' hashes within a Hamming radius, each pair once.

    Both sides hold a ``hash`` column and the ``by`` columns, which must be
    equal. Copies of a hash are folded together first. The bands meet in an
    equi-join, and the radius is tested inside it, so that candidates that fail
    are never shuffled.

    ``sizes`` are the numbers of distinct hashes, counted here if not given.
    ``symmetric`` expects the same table on both sides and gives every pair of
    different hashes in one order only, having tested it in one order only.
    Returns ``by``, ``left_hash``, ``right_hash`` and ``distance``.
    """
    by = by or []
    left, right = (side.select(*by, "hash").filter(F.col("hash").isNotNull()) for side in (left, right))
    left = left.distinct()
    probing, indexed = sizes or (left.count(), right.distinct().count())
    plan = plan or BandPlan.for_sizes(radius, probing, indexed)
    index_rows = indexed * len(plan.used)
    if index_rows > _BROADCAST_ROWS and probing * plan.probes <= _BROADCAST_ROWS and not symmetric:
        # Few probes go to a large index, which is then neither shuffled nor folded.
        probes = F.broadcast(_probe_rows(left, plan, by))
        index = _index_rows(right, plan, by)
        return _meet(probes, index, [*by, "band", "key"], plan, by).distinct()

    work = probing * plan.probes + probing * indexed * plan.pair_share / 10
    # A fixed number: a few megabytes of hashes turn into many probe rows.
    left = left.repartition(max(1, min(100_000, ceil(work / _TASK_WORK))), *by, "hash")
    probes = _probe_rows(left, plan, by, symmetric)
    index = _index_rows(right.distinct(), plan, by)

    keys = [*by, "band", "key"]
    hot = hot_keys(index, keys, split_rows, index_rows)
    if hot is not None:
        # Both sides of a hot band value are cut, giving a grid of small joins.
        index = assign_chunk(index, hot, keys, "right_hash", "right_chunk")
        index = visit_chunks(index, hot, keys, "left_chunk")
        probes = assign_chunk(probes, hot, keys, "left_hash", "left_chunk")
        probes = visit_chunks(probes, hot, keys, "right_chunk")
        keys += ["left_chunk", "right_chunk"]
    small = hot is None and index_rows <= _BROADCAST_ROWS
    index = F.broadcast(index) if small else index.hint("merge")
    return _meet(probes, index, keys, plan, by, symmetric)


def near_hashes(left: DataFrame, right: DataFrame, radius: int, *, sizes: tuple[int, int], split_rows: int = 200_000) -> DataFrame:
    """Different hashes (``hash``) of the right side within the radius of any of the left side; ``sizes`` as for ``hash_pairs``."""
    if all_pairs_cheaper(BandPlan.for_sizes(radius, *sizes), *sizes):
        left, right = (side.select("hash").filter(F.col("hash").isNotNull()).distinct() for side in (left, right))
        return near_any(left, right, radius, max(sizes)).distinct()
    pairs = hash_pairs(left, right, radius, sizes=sizes, split_rows=split_rows)
    return pairs.select(F.col("right_hash").alias("hash")).distinct()


def _meet(
    probes: DataFrame, index: DataFrame, keys: list[str], plan: BandPlan, by: list[str], symmetric: bool = False
) -> DataFrame:
    """Probe and index rows of one band value that lie within the radius."""
    difference = F.col("left_hash").bitwiseXOR(F.col("right_hash"))
    condition = (F.bit_count(difference) <= plan.radius) & _first_band(plan)
    if symmetric:
        condition = condition & (~F.col("p.straight") | (F.col("left_hash") < F.col("right_hash")))
    for key in keys:
        condition = condition & (F.col(f"p.{key}") == F.col(f"x.{key}"))
    return probes.alias("p").join(index.alias("x"), condition).select(
        *[F.col(f"p.{c}").alias(c) for c in by],
        "left_hash",
        "right_hash",
        F.bit_count(difference).alias("distance"),
    )


def all_pairs_cheaper(plan: BandPlan, probing: int, indexed: int) -> bool:
    """Whether testing every pair block by block costs less than the bands do."""
    return probing * indexed * _CELL_COST <= plan.cost(probing, indexed)


def hamming_join(
    left: DataFrame,
    right: DataFrame,
    radius: int = 10,
    *,
    by: list[str] | None = None,
    plan: BandPlan | None = None,
    split_rows: int = 200_000,
    nearest: str | None = None,
    left_columns: list[str] | None = None,
    right_columns: list[str] | None = None,
    verify: Verify | None = None,
) -> DataFrame:
    """All pairs of rows whose hashes lie within a Hamming radius.

    Both sides hold ``id``, ``hash`` and the ``by`` columns. Rows that share a
    hash are searched once and told apart at the end, a hot hash in chunks; where
    the radius is so wide that bands leave most pairs to be tested, all rows are
    compared block by block instead. Returns ``by``, ``left_id``, ``right_id``,
    ``distance`` and the named columns of either side, as ``left_`` and ``right_`` ones.

    ``nearest`` names a column of both sides, such as ``id``: rows that share it are one
    thing with several hashes (and the same named columns), and each pair of things
    comes once, with its least distance. Rows where it is NULL are left out.

    ``verify`` is a further test of pairs, such as ``duplicates.BestMatch``. Only pairs that
    pass it are returned, with its result as ``match``. Where rows are compared block by
    block it runs there too, so what it reads is sent with rows and not with pairs.
    """
    by = by or []
    extra = {"left": list(left_columns or []), "right": list(right_columns or [])}
    names = [*by, "left_id", "right_id", "distance", *[f"{side}_{c}" for side in extra for c in extra[side]]]
    if verify is not None:
        names.append("match")
        extra = {"left": [*extra["left"], *verify.left], "right": [*extra["right"], *verify.right]}
    same = left is right and extra["left"] == extra["right"]

    def kept(side: DataFrame, columns: list[str]) -> DataFrame:
        there = F.col("hash").isNotNull() if nearest is None else F.col("hash").isNotNull() & F.col(nearest).isNotNull()
        return materialize(side.filter(there).select(*dict.fromkeys([*by, "id", "hash", *([nearest] if nearest else []), *columns])))

    # What rows come from is read once, for they are read several times below.
    left = kept(left, extra["left"])
    right = left if same else kept(right, extra["right"])
    left_rows, probing = _sizes(left)
    right_rows, indexed = (left_rows, probing) if same else _sizes(right)
    if plan is None and all_pairs_cheaper(BandPlan.for_sizes(radius, probing, indexed), probing, indexed):
        sides = []
        for side, rows in (("left", left), ("right", right)):
            hashes = F.array("hash")
            if nearest is not None:
                columns = [c for c in dict.fromkeys(["id", *extra[side]]) if c != nearest]
                rows = rows.groupBy(*dict.fromkeys([*by, nearest])).agg(
                    F.collect_set("hash").alias("hashes"), *[F.any_value(c).alias(c) for c in columns]
                )
                hashes = F.col("hashes")
            carried = dict.fromkeys(["id", *extra[side]])
            sides.append(rows.select(*by, *[F.col(c).alias(f"{side}_{c}") for c in carried], hashes.alias("hashes")))
        unsent = () if verify is None else tuple(f"{side}_{c}" for side in extra for c in extra[side] if f"{side}_{c}" not in names)
        return nearest_pairs(*sides, radius, by, max(left_rows, right_rows), verify, unsent).select(names)
    pairs = hash_pairs(
        left, right, radius, by=by, plan=plan, sizes=(probing, indexed), split_rows=split_rows
    )
    for side, rows, total in (("left", left, left_rows), ("right", right, right_rows)):
        carried = [c for c in dict.fromkeys(["id", *([nearest] if nearest else []), *extra[side]]) if c != "hash"]
        members = rows.select(*by, F.col("hash").alias(f"{side}_hash"), *[F.col(c).alias(f"{side}_{c}") for c in carried])
        pairs = chunked_join(pairs, members, [*by, f"{side}_hash"], f"{side}_id", split_rows, total)
    if nearest is not None:
        keys = [*by, f"left_{nearest}", f"right_{nearest}"]
        rest = dict.fromkeys(f"{side}_{c}" for side in extra for c in ["id", *extra[side]])
        pairs = pairs.groupBy(*keys).agg(F.min("distance").alias("distance"), *[F.any_value(c).alias(c) for c in rest if c not in keys])
    if verify is not None:
        pairs = pairs.withColumn("match", verify.column()).filter("match IS NOT NULL")
    return pairs.select(names)


def hamming_self_join(
    rows: DataFrame,
    radius: int = 10,
    *,
    by: list[str] | None = None,
    plan: BandPlan | None = None,
    split_rows: int = 200_000,
) -> DataFrame:
    """All pairs of different rows of one table whose hashes lie within a Hamming radius.

    As ``hamming_join`` of the table with itself, but with each pair once, the
    smaller id on the left, and each pair of hashes tested once.
    """
    by = by or []
    rows = materialize(rows.filter(F.col("hash").isNotNull()).select(*by, "id", "hash"))
    total, distinct = _sizes(rows)
    pairs = hash_pairs(
        rows, rows, radius, by=by, plan=plan, sizes=(distinct, distinct), split_rows=split_rows, symmetric=True
    )
    repeated = rows.groupBy(*by, "hash").count().filter("count > 1")
    hash_ = F.col("hash")
    pairs = pairs.union(repeated.select(*by, hash_.alias("left_hash"), hash_.alias("right_hash"), F.lit(0).alias("distance")))
    for side in ("left", "right"):
        members = rows.select(*by, hash_.alias(f"{side}_hash"), F.col("id").alias(f"{side}_id"))
        pairs = chunked_join(pairs, members, [*by, f"{side}_hash"], f"{side}_id", split_rows, total)
    kept = (F.col("left_hash") != F.col("right_hash")) | (F.col("left_id") < F.col("right_id"))
    return pairs.filter(kept).select(
        *by, F.least("left_id", "right_id").alias("left_id"), F.greatest("left_id", "right_id").alias("right_id"), "distance"
    )


def _sizes(rows: DataFrame) -> tuple[int, int]:
    """Number of rows and, nearly, of different hashes."""
    return tuple(rows.agg(F.count("hash"), F.approx_count_distinct("hash")).first())


#: Pivots that a cell is divided by.
PIVOTS = 32
#: Values of a cell that are compared with each other without dividing it once more.
CELL = 256
_LEVELS = 6


def _pivots(cells: DataFrame, pivots: int) -> DataFrame:
    """cell, pivots: a few values of every cell, those of least hash."""
    rank = F.xxhash64("value")
    drawn = cells.filter("home").groupBy("cell").agg(F.count(F.lit(1)).alias("size"))
    share = 4.0 * pivots / F.col("size")
    some = cells.filter("home").join(drawn, "cell").filter(F.pmod(rank, F.lit(1_000_003)) <= share * 1_000_003)
    first = some.groupBy("cell").agg(F.array_sort(F.collect_list(F.struct(rank.alias("rank"), F.col("value")))).alias("some"))
    return first.select("cell", F.transform(F.slice("some", 1, pivots), lambda s: s["value"]).alias("pivots"))


def metric_self_join(
    rows: DataFrame,
    distance: Callable[[Column, Column], Column],
    radius: float,
    value: str = "value",
    *,
    pivots: int = PIVOTS,
    cell: int = CELL,
    split_rows: int = 200_000,
) -> DataFrame:
    """All pairs of rows (``id``, ``value``) within a radius of any metric: left_id < right_id, distance.

    Needs no key that matches share. Space is divided into cells around pivots, drawn
    from the values: a value is at home with its nearest pivot, and visits every pivot
    at most ``2 * radius`` further away. By the triangle inequality a value visits the
    home of each of its matches, so comparing those at home in a cell with its visitors
    finds every pair. Cells with many values are divided again, around pivots of their
    own. Within a cell, values are compared only where their distances to the pivot
    differ by no more than the radius.

    ``distance`` takes two columns, is a metric, and may be NULL for values that match
    nothing. Rows with equal values are folded and come back as pairs at the end, hot
    values and cells that cannot be divided in chunks. NULL values match nothing.
    """
    every = materialize(rows.select("id", F.col(value).alias("value")).filter(F.col("value").isNotNull()))
    values = every.select("value").distinct()
    cells = materialize(values.select(F.lit(0).cast("bigint").alias("cell"), "value", F.lit(True).alias("home"), F.lit(0.0).alias("off")))
    done: list[DataFrame] = []
    for level in range(_LEVELS):
        sizes = cells.groupBy("cell").agg(F.count_if("home").alias("at_home"))
        large = materialize(sizes.filter(F.col("at_home") > cell).select("cell"))
        if large.isEmpty():
            break
        done.append(cells.join(large, "cell", "left_anti"))
        divided = materialize(cells.join(large, "cell", "left_semi"))
        drawn = materialize(_pivots(divided, pivots))
        # A large cell's rows are many under one key, and its pivots are one row.
        total = divided.count()
        # A fixed number: few bytes of values turn into many distances.
        divided = divided.repartition(_tasks(total * pivots))
        met = chunked_join(drawn, divided, ["cell"], "value", split_rows, total)
        away = F.transform("pivots", lambda p: distance(F.col("value"), p).cast("double"))
        met = met.select("cell", "value", "home", away.alias("away")).withColumn("nearest", F.array_min("away"))
        own = F.array_position("away", F.col("nearest")) - 1
        spread = met.select("cell", "value", "home", "nearest", own.alias("own"), F.posexplode("away").alias("at", "off"))
        spread = spread.filter(F.col("off") <= F.col("nearest") + 2 * radius)
        cells = materialize(spread.select(
            F.xxhash64("cell", "at", F.lit(level)).alias("cell"), "value", (F.col("home") & (F.col("at") == F.col("own"))).alias("home"), "off"
        ))
    for part in done:
        cells = cells.union(part)
    cells = materialize(cells)
    near = _within_cells(cells, distance, radius, split_rows)
    same = every.groupBy("value").count().filter("count > 1").select(
        F.col("value").alias("left_value"), F.col("value").alias("right_value"), distance(F.col("value"), F.col("value")).alias("distance")
    ).filter(F.col("distance") <= radius)
    return _members(materialize(near.union(same)), every).select(
        F.least("left_id", "right_id").alias("left_id"), F.greatest("left_id", "right_id").alias("right_id"), "distance"
    )


def _tasks(tests: float) -> int:
    """Tasks for so many tests of pairs."""
    return max(1, min(100_000, ceil(tests / 10 / _TASK_WORK)))


def _members(pairs: DataFrame, rows: DataFrame) -> DataFrame:
    """left_id, right_id, distance: pairs of values (``left_value``, ``right_value``) as pairs of all rows that have them.

    Rows of a value come in groups of bounded size, and pairs of groups are dealt over
    tasks by the number of pairs of rows, whatever the bytes they are made from.
    """
    counts = rows.groupBy("value").agg(F.count(F.lit(1)).alias("rows"))
    groups = F.ceil(F.col("rows") / _GROUP)
    grouped = (
        rows.join(counts, "value").withColumn("part", F.pmod(F.xxhash64("id"), groups))
        .groupBy("value", "part").agg(F.collect_list(F.struct("id")).alias("ids"))
    )
    made = pairs
    for side in ("left", "right"):
        made = made.join(counts.select(F.col("value").alias(f"{side}_value"), F.col("rows").alias(f"{side}_rows")), f"{side}_value")
        members = grouped.select(F.col("value").alias(f"{side}_value"), F.col("part").alias(f"{side}_part"), F.col("ids").alias(f"{side}_ids"))
        pairs = pairs.join(members, f"{side}_value")
    total = made.agg(F.sum(F.col("left_rows") * F.col("right_rows"))).first()[0] or 0
    dealt = pairs.withColumn("same", F.col("left_value") == F.col("right_value")).repartition(
        max(1, min(100_000, ceil(total / _TASK_PAIRS))), "left_value", "right_value", "left_part", "right_part"
    )
    found = dealt.select("same", "distance", "right_ids", F.inline("left_ids").alias("left_id")).select(
        "same", "distance", "left_id", F.inline("right_ids").alias("right_id")
    )
    return found.filter(~F.col("same") | (F.col("left_id") < F.col("right_id")))


def candidate_pairs(cells: DataFrame, radius: float, split_rows: int = 200_000) -> DataFrame:
    """Pairs of values of one cell that the distances to its pivot allow, each unordered pair once."""
    total = cells.count()
    hot = hot_keys(cells, ["cell"], split_rows, total)
    left = cells.filter("home").select("cell", F.col("value").alias("left_value"), F.col("off").alias("left_off"))
    right = cells.select("cell", F.col("value").alias("right_value"), F.col("off").alias("right_off"))
    keys = ["cell"]
    if hot is not None:
        left = visit_chunks(assign_chunk(left, hot, keys, "left_value", "_left"), hot, keys, "_right")
        right = visit_chunks(assign_chunk(right, hot, keys, "right_value", "_right"), hot, keys, "_left")
        keys = ["cell", "_left", "_right"]
    # Each value meets about as many others as a cell may hold.
    tasks = _tasks(total * CELL)
    met = left.repartition(tasks, *keys).join(right.repartition(tasks, *keys), keys)
    return met.filter((F.col("left_value") < F.col("right_value")) & (F.abs(F.col("left_off") - F.col("right_off")) <= radius))


def _within_cells(cells: DataFrame, distance: Callable[[Column, Column], Column], radius: float, split_rows: int) -> DataFrame:
    met = candidate_pairs(cells, radius, split_rows)
    scored = met.withColumn("distance", distance(F.col("left_value"), F.col("right_value")))
    return scored.filter(F.col("distance") <= radius).select("left_value", "right_value", "distance")


def similarity_join(
    left: DataFrame,
    right: DataFrame,
    distance: Callable[[Column, Column], Column],
    max_distance: float,
    candidates: Callable[[DataFrame, DataFrame], DataFrame],
    value: str = "value",
) -> DataFrame:
    """Radius join under any metric.

    ``candidates`` returns (left_id, right_id) pairs that include every pair
    within the bound; ``distance`` decides over them. A NULL distance is no match.
    Pairs that come with ``left_value`` and ``right_value`` are tested where they are
    made; to others the values are joined by id.
    """
    pairs = candidates(left, right)
    for side, rows in (("left", left), ("right", right)):
        if f"{side}_value" not in pairs.columns:
            pairs = pairs.join(rows.select(F.col("id").alias(f"{side}_id"), F.col(value).alias(f"{side}_value")), f"{side}_id")
    scored = pairs.withColumn("distance", distance(F.col("left_value"), F.col("right_value")))
    return scored.filter(F.col("distance") <= max_distance).select("left_id", "right_id", "distance")


def hamming_distance(left: Column, right: Column) -> Column:
    """Metric of ``hamming_join``, for use with ``similarity_join``."""
    return hamming(left, right)
