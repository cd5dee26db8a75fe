"""Join of texts by the Jaccard similarity of their word n-grams, over prefix trees.

Every text is the set of the 64-bit hashes of its n-grams, in one global order: by
hash, but n-grams that several texts have come last. The join has two halves:

* Candidates. Of a set of n n-grams with t n in common with any match, the first
  n - t n + 1 hold one that the match has among its own first ones. So sets meet at
  the first edges of their paths in the tree of ordered sets. Shared
  n-grams are late in the order, so a common passage brings texts together only if
  little else is in them.
* Verification. The sets that a query set is to be compared with are stored in a
  tree along the order. A traversal carries the overlap so far into all sets below a
  node and leaves a subtree when what remains cannot reach the bound.

Each first edge has one leader, the text that shares most of them or is nearest to what
the others have in common, and a text is first
compared with the leader it meets most often. After that most of a group of copies is
one component; the others lead in further rounds, as long as these find links and are quicker than testing all open pairs, and in
the end all pairs that still meet in different components and may match are compared. So a group
costs its size, not its square, and no link that could join two components is left out.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from imprint.llm.common import SOLID, batch, components, mix, small_batches, word_slices
from imprint.session import materialize

#: Ids of candidates that may be sent to every task to fetch their texts: about 40 MB as a hash table.
SMALL_IDS = 1_000_000
#: Members compared in one tree.
BLOCK = 128

#: Texts with an n-gram beyond which it counts as common and comes last.
COMMON = 1
#: Common n-grams that may be sent to every task, 8 bytes each; beyond, only the more common ones are.
MOST_COMMON = 4_000_000
#: Counted are so many times the n-grams that a text has first, because rarer ones move up.
WIDER = 1.5

#: Times, at most, that each text is compared with a leader before all that is still open is compared.
ROUNDS = 6
#: Rounds end when fewer than one text in so many finds a link in one.
WORTH = 100
#: Pairs, for each row of a text and an n-gram it shares, that cost no more to test at once than a round of leaders.
TESTS = 1000
#: Texts of an n-gram beyond which their sketches tell the leader.
CROWD = 8

_STEP = 64
#: Words of a parity sketch, 1024 bits.
_SKETCH = 16
_SKETCH_COLUMNS = [f"s{i}" for i in range(_SKETCH)]


class Threshold:
    """Jaccard similarity of at least ``part / whole``, in integers."""

    def __init__(self, part: int, whole: int):
        if not 0 < part < whole:
            raise ValueError("the similarity must lie between 0 and 1")
        self.part, self.whole = part, whole

    def largest(self, n: int) -> int:
        """Size of the largest set that can match one of ``n``."""
        return n * self.whole // self.part

    def overlap(self, a: int, b: int) -> int:
        """Least intersection of matching sets of these sizes."""
        return -(-self.part * (a + b) // (self.part + self.whole))

    def first(self, n: int) -> int:
        """How many n-grams of a set of ``n`` hold one that a match has among its own; 0 if only an equal set matches."""
        alone = self.largest(n) == n and n * self.part > (n - 1) * self.whole and self.overlap(n, n) == n
        return 0 if alone else n - -(-self.part * n // self.whole) + 1


def ngram_sets(words, n: int):
    """The ordered set of n-gram hashes of each text of a scan; fewer words are one n-gram."""
    begin, value = words.windows(n)
    bounds = np.searchsorted(begin, words.first)
    for i in range(len(words.first) - 1):
        a, b = words.first[i], words.first[i + 1]
        if b - a >= n:
            yield np.unique(value[bounds[i] : bounds[i + 1]])
        elif b > a:
            one = np.array([b - a], np.uint64)
            for k in range(a, b):
                one = mix(one * np.uint64(31) + words.hash[k : k + 1])
            yield one
        else:
            yield np.empty(0, np.uint64)


def _first_ones(values: np.ndarray, limit: Threshold, common: np.ndarray) -> np.ndarray:
    """The first n-grams of a set by which it meets its matches."""
    n = limit.first(len(values)) if len(values) else 0
    if n and len(common):
        late = common[np.minimum(np.searchsorted(common, values), len(common) - 1)] == values
        early = values[~late]
        return early[:n] if len(early) >= n else np.concatenate([early, values[late][: n - len(early)]])
    return values[:n]


def _list_first(n: int, limit: Threshold):
    """The first n-grams of all texts, were none common, and some more."""

    def run(batches):
        for b in batches:
            for _, _, words in word_slices(b.column("text"), SOLID, lower=True):
                found = [v[: int(WIDER * limit.first(len(v)))] for v in ngram_sets(words, n) if len(v)]
                yield batch(key=np.concatenate([np.empty(0, np.uint64), *found]).view(np.int64))

    return run


def common_ngrams(texts: DataFrame, n: int, limit: Threshold, least: int = COMMON, most: int = MOST_COMMON) -> np.ndarray:
    """N-grams that more than ``least`` rows have among their first ones or soon after, sorted; ``least`` rises so that they are ``most`` at most.

    Any choice gives the same links, as long as it is the same for all texts.
    """
    counts = materialize(
        texts.select("text").mapInArrow(_list_first(n, limit), "key bigint")
        .groupBy("key").agg(F.count(F.lit(1)).alias("rows")).filter(F.col("rows") > least)
    )
    while counts.count() > most:
        least *= 2
        counts = counts.filter(F.col("rows") > least)
    found = counts.select("key").toArrow().column("key").to_numpy()
    return np.sort(found.view(np.uint64))


def _describe(n: int, limit: Threshold, shared):
    def run(batches):
        common = shared.value
        for b in batches:
            for lo, hi, words in word_slices(b.column("text"), SOLID, lower=True):
                sizes, digests, sketches, keys = [], [], [], []
                for values in ngram_sets(words, n):
                    sizes.append(len(values))
                    digests.append(mix(np.array([np.sum(mix(values), dtype=np.uint64) + np.uint64(len(values))]))[0])
                    parity = np.bincount((values & np.uint64(64 * _SKETCH - 1)).astype(np.int64), minlength=64 * _SKETCH) & 1
                    sketches.append(np.packbits(parity.astype(bool)).view(np.int64))
                    keys.append(_first_ones(values, limit, common).view(np.int64))
                s = np.array(sketches, np.int64).reshape(-1, _SKETCH)
                yield batch(
                    doc_id=b.column("doc_id").slice(lo, hi - lo),
                    digest=b.column("digest").slice(lo, hi - lo),
                    n_shingles=np.array(sizes, np.int64),
                    node=np.array(digests, np.uint64).view(np.int64),
                    **{c: s[:, i].copy() for i, c in enumerate(_SKETCH_COLUMNS)},
                    keys=pa.ListArray.from_arrays(
                        np.concatenate([[0], np.cumsum([len(k) for k in keys])]).astype(np.int32), np.concatenate(keys)
                    ),
                )

    return run


def _ordered_sets(n: int):
    def run(batches):
        for b in batches:
            for lo, hi, words in word_slices(b.column("text"), SOLID, lower=True):
                out = [v.tobytes() for v in ngram_sets(words, n)]
                yield batch(node=b.column("node").slice(lo, hi - lo), grams=pa.array(out, pa.binary()))

    return run


class PrefixTree:
    """Ordered sets along shared beginnings; edges hold runs of n-grams."""

    def __init__(self, sets: list[tuple[int, np.ndarray]]):
        ordered = sorted(sets, key=lambda x: x[1].astype(">u8").tobytes())
        self.root = self._build(ordered, 0)

    def _build(self, sets, depth):
        """Node (run of n-grams, depth below it, least size, largest size, ends, children) of sets equal up to ``depth``."""
        first, last = sets[0][1], sets[-1][1]
        n = min(len(first), len(last))
        differ = np.flatnonzero(first[depth:n] != last[depth:n])
        to = depth + int(differ[0]) if len(differ) else n
        ends = [name for name, values in sets if len(values) == to]
        rest = [x for x in sets if len(x[1]) > to]
        children, at = [], 0
        while at < len(rest):
            end = at
            while end < len(rest) and rest[end][1][to] == rest[at][1][to]:
                end += 1
            children.append(self._build(rest[at:end], to))
            at = end
        sizes = [len(v) for _, v in sets]
        return first[depth:to], to, min(sizes), max(sizes), ends, children

    def matches(self, query: np.ndarray, limit: Threshold):
        """Names of the stored sets that match ``query``."""
        n, todo = len(query), [(self.root, 0)]
        while todo:
            (run, depth, least, most, ends, children), overlap = todo.pop()
            need, alive = limit.overlap(n, least), True
            for k in range(0, len(run), _STEP):
                part = run[k : k + _STEP]
                at = np.searchsorted(query, part)
                overlap += int(np.count_nonzero(query[np.minimum(at, n - 1)] == part))
                left = min(most - (depth - len(run) + k + len(part)), n - int(at[-1]))
                if overlap + left < need:
                    alive = False
                    break
            if alive:
                if ends and overlap >= limit.overlap(n, depth):
                    yield from ends
                todo += [(child, overlap) for child in children]


def _verify(limit: Threshold):
    """Linked pairs among rows (query, block, role, node, grams) that come sorted, each query before its members."""

    def run(batches):
        at = query = None
        held: list[tuple[int, np.ndarray]] = []

        def found():
            if held and query is not None and len(query):
                return [(at[0], name) for name in PrefixTree(held).matches(query, limit)]
            return []

        for b in batches:
            pairs = []
            places = zip(*(b.column(k).to_pylist() for k in range(4)))
            for (q, block, role, node), grams in zip(places, b.column(4)):
                if (q, block) != at:
                    pairs += found()
                    at, query, held = (q, block), None, []
                values = np.frombuffer(grams.as_py(), np.uint64)
                if role == 0:
                    query = values
                else:
                    held.append((node, values))
            yield batch(a=pa.array([p[0] for p in pairs], pa.int64()), b=pa.array([p[1] for p in pairs], pa.int64()))
        pairs = found()
        yield batch(a=pa.array([p[0] for p in pairs], pa.int64()), b=pa.array([p[1] for p in pairs], pa.int64()))

    return run


def _may_match(limit: Threshold, x: str, y: str) -> F.Column:
    """What sizes and parity sketches allow: each n-gram in only one set flips one bit."""
    nx, ny = F.col(f"{x}.n_shingles"), F.col(f"{y}.n_shingles")
    flips = sum((F.bit_count(F.col(f"{x}.{c}").bitwiseXOR(F.col(f"{y}.{c}"))) for c in _SKETCH_COLUMNS), F.lit(0))
    return (
        (F.least(nx, ny) * limit.whole >= F.greatest(nx, ny) * limit.part)
        & (flips * (limit.whole + limit.part) <= (nx + ny) * (limit.whole - limit.part))
    )


def _linked(pairs: DataFrame, nodes: DataFrame, texts: DataFrame, n: int, limit: Threshold, small: int) -> DataFrame:
    """Those of the (query, node) pairs whose sets match."""
    blocks = pairs.groupBy("query").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("blocks"))
    members = pairs.join(blocks, "query").select(
        "query", F.pmod(F.xxhash64("node"), "blocks").cast("int").alias("block"), F.lit(1).alias("role"), "node"
    )
    queries = blocks.select(
        "query", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), F.lit(0).alias("role"),
        F.col("query").alias("node"),
    )
    wanted = materialize(
        pairs.select("node").union(blocks.select("query")).distinct().join(nodes.select("node", "rep", "rep_digest"), "node")
    )
    few = wanted.count() <= small
    # A text is fetched by id and digest: ids may be null, or on several texts.
    named = texts.doc_id.eqNullSafe(wanted.rep) & (texts.digest == wanted.rep_digest)
    sets = (
        texts.join(F.broadcast(wanted) if few else wanted, named)
        .select("node", "text")
        .mapInArrow(_ordered_sets(n), "node bigint, grams binary")
        .groupBy("node").agg(F.first("grams").alias("grams"))
    )
    rows = members.union(queries).join(sets, "node").select("query", "block", "role", "node", "grams")
    return (
        rows.repartition("query", "block")
        .sortWithinPartitions("query", "block", "role")
        .mapInArrow(_verify(limit), "a bigint, b bigint")
    )


def _pair() -> list[F.Column]:
    return [F.least("query", "node").alias("low"), F.greatest("query", "node").alias("high")]


def _majority(rows: DataFrame, seed: int) -> DataFrame:
    """key and m0 to m15: the sketch that two of three texts of each key have, bit by bit."""
    some = F.struct(*_SKETCH_COLUMNS)
    turned = [F.col("node").bitwiseXOR(F.lit(int(mix(np.array([3 * seed + i], np.uint64)).view(np.int64)[0]))) for i in range(3)]
    three = rows.groupBy("key").agg(*[F.min_by(some, t).alias(x) for x, t in zip("abc", turned)])
    a, b, c = ([F.col(f"{x}.{s}") for s in _SKETCH_COLUMNS] for x in "abc")
    return three.select(
        "key", *[x.bitwiseAND(y).bitwiseOR(x.bitwiseAND(z)).bitwiseOR(y.bitwiseAND(z)).alias(f"m{i}") for i, (x, y, z) in enumerate(zip(a, b, c))]
    )


def _leads(grouped: DataFrame, traits: DataFrame, round_: int) -> DataFrame:
    """key, lead (node, root): a leader of each first n-gram.

    A text that shares most of its first n-grams has few edits of its own, so it leads
    best. Among many, where most texts have an edit or two, it is the one next to the sketch that they have
    in common. After the first round, those that are not yet in the largest component of their
    n-gram lead.
    """
    candidates = grouped.filter("outside").select("key", "node", "root")
    many = materialize(candidates.groupBy("key").agg(F.count(F.lit(1)).alias("size")).filter(F.col("size") > CROWD).select("key"))
    central = grouped.groupBy("node").agg(F.count(F.lit(1)).alias("edges"))
    few = candidates.join(many, "key", "left_anti").join(central, "node")
    leads = few.groupBy("key").agg(F.max(F.struct("edges", "node", "root")).alias("lead")).select("key", "lead.node", "lead.root")
    crowd = candidates.join(many, "key", "left_semi").join(traits, "node")
    flips = sum((F.bit_count(F.col(c).bitwiseXOR(F.col(f"m{i}"))) for i, c in enumerate(_SKETCH_COLUMNS)), F.lit(0))
    near = crowd.join(_majority(crowd, round_), "key").groupBy("key").agg(F.min(F.struct(flips.alias("flips"), "node", "root")).alias("lead"))
    return leads.union(near.select("key", "lead.node", "lead.root")).select("key", F.struct("node", "root").alias("lead"))


def _with_leaders(grouped: DataFrame, traits: DataFrame, limit: Threshold, round_: int) -> DataFrame:
    """query, node, shared, low, high: texts with the leaders of their first n-grams, in another component, that they may match."""
    met = (
        grouped.join(_leads(grouped, traits, round_), "key").filter(F.col("root") != F.col("lead.root"))
        .groupBy(F.col("lead.node").alias("query"), "node").agg(F.count(F.lit(1)).alias("shared"))
    )
    x, y = traits.alias("x"), traits.alias("y")
    return (
        met.alias("p").join(x, F.col("p.query") == F.col("x.node")).join(y, F.col("p.node") == F.col("y.node"))
        .filter(_may_match(limit, "x", "y")).select("p.query", "p.node", "p.shared").select("query", "node", "shared", *_pair())
    )


def _grouped(members: DataFrame, roots: DataFrame) -> DataFrame:
    """key, node, root, size, outside of n-grams whose texts are not all in one component.

    ``size`` counts the texts of the n-gram, and ``outside`` are those that are not in
    the component that most of them are in.
    """
    rooted = members.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    parts = rooted.groupBy("key", "root").agg(F.count(F.lit(1)).alias("part"))
    largest = parts.groupBy("key").agg(F.sum("part").alias("size"), F.max(F.struct("part", "root")).alias("largest"))
    return materialize(
        rooted.join(largest.filter(F.col("size") > F.col("largest.part")), "key")
        .select("key", "node", "root", "size", (F.col("root") != F.col("largest.root")).alias("outside"))
    )


def _all_open(grouped: DataFrame, traits: DataFrame, limit: Threshold) -> DataFrame:
    """query, node, low, high: all pairs of texts that share a first n-gram, in different components, and may match.

    One text of a pair at least is outside the largest component of the n-gram.
    """
    open_ = grouped.join(traits, "node")
    x, y = open_.filter("outside").alias("x"), open_.alias("y")
    return (
        x.join(y, (F.col("x.key") == F.col("y.key")) & (F.col("x.root") != F.col("y.root")) & _may_match(limit, "x", "y"))
        .select(F.least("x.node", "y.node").alias("query"), F.greatest("x.node", "y.node").alias("node"))
        .distinct().select("query", "node", *_pair())
    )


def _texts(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    text = F.coalesce(F.col(text_col), F.lit(""))
    return docs.select(F.col(id_col).alias("doc_id"), text.alias("text"), F.xxhash64(text).alias("digest"))


def link_texts(docs: DataFrame, n: int, part: int, whole: int, small_ids: int = SMALL_IDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, digest (of the text), n_shingles, group of every row; ``group`` is null where the set is empty.

    The first n-grams of all texts are shuffled three times; leaders, pairs and sets
    of candidates grow with the number of near copies only. Beyond ``small_ids``
    candidates the texts are shuffled to them.
    """
    with small_batches(docs.sparkSession):
        return _link_texts(_texts(docs, id_col, text_col), n, Threshold(part, whole), small_ids)


def _link_texts(texts: DataFrame, n: int, limit: Threshold, small_ids: int) -> DataFrame:
    kind = dict(texts.dtypes)["doc_id"]
    common = texts.sparkSession.sparkContext.broadcast(common_ngrams(texts, n, limit))
    sets = materialize(
        texts.select("doc_id", "digest", "text").mapInArrow(
            _describe(n, limit, common),
            f"doc_id {kind}, digest bigint, n_shingles bigint, node bigint, {', '.join(f'{c} bigint' for c in _SKETCH_COLUMNS)}, keys array<bigint>",
        )
    )
    common.unpersist()
    full = sets.filter("n_shingles > 0")
    keys = full.select("node", F.explode("keys").alias("key"))
    shared = materialize(
        keys.groupBy("key").agg(F.min("node").alias("low"), F.max("node").alias("high")).filter("low < high").select("key")
    )
    members = materialize(keys.join(shared, "key").select("key", "node").distinct())
    involved = materialize(
        full.join(members.select("node").distinct(), "node", "left_semi")
        .groupBy("node", "n_shingles", *_SKETCH_COLUMNS)
        .agg(F.min_by("doc_id", "digest").alias("rep"), F.min("digest").alias("rep_digest"))
    )
    traits = involved.select("node", "n_shingles", *_SKETCH_COLUMNS)
    links = tested = first = None
    grouped = members.select("key", "node", F.col("node").alias("root"), F.lit(True).alias("outside"))
    round_, last = 0, False
    while not last:
        last = round_ >= ROUNDS
        found = _all_open(grouped, traits, limit) if last else _with_leaders(grouped, traits, limit, round_)
        if tested is not None:
            found = found.join(tested, ["low", "high"], "left_anti")
        if not last:
            # Most texts need no more than their best leader, so a text is sent once.
            found = found.groupBy("node").agg(F.max(F.struct("shared", "query", "low", "high")).alias("x")).select("x.query", "node", "x.low", "x.high")
        found = materialize(found.select("query", "node", "low", "high"))
        round_ += 1
        if found.isEmpty():
            round_ = ROUNDS  # leaders have nothing more to be compared with
            continue
        linked = materialize(_linked(found.select("query", "node"), involved, texts, n, limit, small_ids))
        links = linked if links is None else links.union(linked)
        now = found.select("low", "high")
        tested = now if tested is None else tested.union(now)
        first = components(links)
        if last:
            break
        grouped = _grouped(members, first)
        rows, nodes, tests = grouped.agg(
            F.count(F.lit(1)), F.approx_count_distinct("node"), F.coalesce(F.sum(F.when(F.col("outside"), F.col("size"))), F.lit(0))
        ).first()
        if linked.count() * WORTH < nodes or tests <= TESTS * rows:
            round_ = ROUNDS
    if first is None:
        first = members.select("node", F.col("node").alias("root")).limit(0)
    named = sets.select("doc_id", "digest", "n_shingles", F.when(F.col("n_shingles") > 0, F.col("node")).alias("node"))
    return named.join(first, "node", "left").select("doc_id", "digest", "n_shingles", F.coalesce("root", "node").alias("group"))


def link_similar(
    docs: DataFrame,
    n: int = 3,
    part: int = 90,
    whole: int = 100,
    small_ids: int = SMALL_IDS,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """Texts grouped by links of similarity ``part / whole`` or more: doc_id, n_shingles, component_id.

    Words lie between ASCII white space, A-Z lower-cased. A text's set has its
    distinct ``n``-word shingles; with fewer words it has the whole sequence as
    one. ``component_id`` is the smallest id reachable over links.

    Null text, empty text and text without words have an empty set and stand
    alone. Texts with equal sets are folded by a 64-bit digest and never paired.
    Every row comes back; rows with the same id and text have equal values. A null
    id never is a component id unless all ids of the component are null. Texts that
    share an id, or have none, are linked each by its own. Other columns are ignored.
    """
    linked = materialize(link_texts(docs, n, part, whole, small_ids, id_col, text_col))
    least = linked.filter("group is not null").groupBy("group").agg(F.min("doc_id").alias("component_id"))
    return linked.join(least, "group", "left").select(
        "doc_id", "n_shingles", F.when(F.col("group").isNull(), F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id")
    )


def keep_first(
    docs: DataFrame, n: int, part: int, whole: int, small_ids: int = SMALL_IDS, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """One row of every group of similar texts, all columns kept: that of the smallest id.

    Null ids come last; of texts with the same id the one with the least digest
    stays, of rows with the same id and text any one. Texts without words are no
    copies of each other, but rows with the same id and text are.
    """
    linked = materialize(link_texts(docs, n, part, whole, small_ids, id_col, text_col))
    place = F.struct(F.col("doc_id").isNull().alias("nameless"), "doc_id", "digest")
    stays = linked.filter("group is not null").groupBy("group").agg(F.min(place).alias("kept"))
    away = ~(F.col("doc_id").eqNullSafe(F.col("kept.doc_id")) & (F.col("digest") == F.col("kept.digest")))
    gone = linked.join(stays, "group").filter(away).select("doc_id", "digest", F.lit(True).alias("copy"))
    again = linked.groupBy("doc_id", "digest").count().filter("count > 1").select("doc_id", "digest", F.lit(False).alias("copy"))
    marked = materialize(gone.union(again).groupBy("doc_id", "digest").agg(F.max("copy").alias("copy")))
    size = marked.count()
    if not size:
        return docs
    taken = {c.lower() for c in docs.columns}
    own = [next(x for x in (f"{c}{'_' * k}" for k in range(99)) if x not in taken) for c in ("digest", "mark_id", "mark_digest", "copy")]
    marked = marked.toDF(own[1], own[2], own[3])
    rows = docs.withColumn(own[0], F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))))
    met = F.col(id_col).eqNullSafe(F.col(own[1])) & (F.col(own[0]) == F.col(own[2]))
    rows = rows.join(F.broadcast(marked) if size <= small_ids else marked, met, "left").filter(F.coalesce(~F.col(own[3]), F.lit(True)))
    # What is left of a mark are rows that repeat an id and its text.
    repeated = rows.filter(F.col(own[3]).isNotNull())
    if marked.filter(~F.col(own[3])).isEmpty():
        return rows.select(docs.columns)
    return rows.filter(F.col(own[3]).isNull()).union(repeated.dropDuplicates([id_col, own[0]])).select(docs.columns)
