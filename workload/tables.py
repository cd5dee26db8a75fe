"""The pipeline's tables as views of the given ones, for Spark and for SQL.

Orders stand for scans and their crops, customers for batches, line items for
candidate pairs and detections, parts for archive entries, events for stage
events, and embeddings for card images. Suppliers are batches without scans.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from imprint.functions.bits import grid_prints

URL_BASE = "https://cdn.example.com/"

# The same text runs on both engines unless a pair (Spark, SQL) is given.
_SIDE = "CASE WHEN o_orderkey % 2 = 0 THEN 'front' ELSE 'back' END"
_EXT = "CASE WHEN o_orderkey % 2 = 0 THEN 'jpg' ELSE 'PNG' END"
_SCAN_STATUS = (
    "CASE WHEN o_orderstatus = 'O' AND o_orderkey % 10 = 0 THEN 'pending' "
    "WHEN o_orderstatus = 'P' THEN 'crop_failed' ELSE 'cropped' END"
)
_BATCH_COLUMNS = (
    "CAST(c_custkey AS BIGINT) AS id, "
    "1704067200 + (c_custkey * 7919) % 31536000 AS created_s, "
    "CASE c_custkey % 7 WHEN 0 THEN NULL WHEN 1 THEN '' ELSE concat(c_mktsegment, ' / ', c_name, '.é') END AS source_label, "
    "CASE c_custkey % 3 WHEN 0 THEN 'complete' WHEN 1 THEN 'cropping' ELSE 'rotation_review' END AS status"
)
_UPLOAD_COLUMNS = (
    "CAST(1000000000000 + s_suppkey AS BIGINT) AS id, "
    "1704067200 + (s_suppkey * 104729) % 31536000 AS created_s, "
    "s_name AS source_label, 'extracting' AS status"
)
_SCAN_COLUMNS = (
    "CAST(o_orderkey AS BIGINT) AS id, CAST(o_custkey AS BIGINT) AS batch_id, "
    f"concat('raw/', o_custkey, '/', o_orderkey, '-', {_SIDE}, '.', lower({_EXT})) AS r2_key_raw, "
    "concat('Card', year(o_orderdate), '-', substr(o_orderpriority, 1, 1), "
    f"CASE WHEN o_orderkey % 2 = 0 THEN '-front.' ELSE '-BACK.' END, {_EXT}) AS original_filename, "
    "concat('card', year(o_orderdate), '-', substr(o_orderpriority, 1, 1)) AS pairing_key, "
    f"{_SIDE} AS side, {_SCAN_STATUS} AS status"
)
_CROP_COLUMNS = (
    "CAST(o_orderkey * 2 + 1 AS BIGINT) AS id, CAST(o_orderkey AS BIGINT) AS raw_scan_id, "
    "CASE WHEN o_orderkey % 11 = 0 THEN NULL ELSE "
    f"concat('cropped/', o_custkey, '/', o_orderkey * 2 + 1, '-', {_SIDE}, '.jpg') END AS r2_key_cropped, "
    f"{_SCAN_STATUS} = 'cropped' AS aspect_ratio_ok, "
    "CASE WHEN o_orderkey % 13 = 0 THEN NULL ELSE CAST((o_orderkey % 4) * 90 AS INT) END AS rotation_degrees, "
    f"CASE WHEN {_SCAN_STATUS} = 'cropped' AND o_orderkey % 15 <> 0 THEN o_orderdate END AS rotation_confirmed_at, "
    "CASE WHEN o_orderkey % 4 <> 3 THEN o_orderkey END AS hash_0"
)
# A decoding failure leaves no crop; neither does a scan still pending.
_HAS_CROP = f"{_SCAN_STATUS} <> 'pending' AND NOT ({_SCAN_STATUS} = 'crop_failed' AND o_orderpriority = '5-LOW')"

_PAIR_KEYS = (
    "SELECT least(l_orderkey, l_partkey) * 2 + 1 AS a, greatest(l_orderkey, l_partkey) * 2 + 1 AS b, "
    "chr(min(ascii(l_returnflag))) AS flag FROM {lineitem} WHERE l_orderkey <> l_partkey GROUP BY 1, 2"
)
_PAIR_STATUS = (
    "CASE WHEN flag = 'N' AND (a + b) % 10 = 0 THEN 'pending' "
    "WHEN flag = 'R' THEN 'confirmed_duplicate' ELSE 'rejected' END"
)
_PAIR_COLUMNS = (
    "{id} AS id, CAST(a AS BIGINT) AS card_crop_id_a, CAST(b AS BIGINT) AS card_crop_id_b, "
    "CASE WHEN (a + b) % 34 = 0 THEN CAST('NaN' AS DOUBLE) WHEN (a + b) % 38 = 0 THEN NULL "
    "ELSE CAST((a * 31 + b) % 64 AS DOUBLE) END AS structural_score, "
    "CASE WHEN (a + b) % 46 = 0 THEN CAST('Infinity' AS DOUBLE) ELSE CAST((a + 7 * b) % 1000 AS DOUBLE) / 1000 END AS color_score, "
    f"(a + b) % 4 = 0 AS filename_match, {_PAIR_STATUS} AS status, "
    f"CASE WHEN {_PAIR_STATUS} <> 'pending' THEN CAST((a + b) % 25 AS BIGINT) END AS reviewed_by"
)
_PAIR_ID = (
    "CAST(conv(substr(md5(concat(a, '-', b)), 1, 15), 16, 10) AS BIGINT)",
    "CAST(('0x' || substr(md5(concat(a, '-', b)), 1, 15)) AS BIGINT)",
)

_ENTRY_NAME = (
    "concat(p_brand, '-', p_size, CASE p_partkey % 5 WHEN 0 THEN '-front.jpg' WHEN 1 THEN '-BACK.PNG' "
    "WHEN 2 THEN '-front.gif' WHEN 3 THEN '.jpg' ELSE '-back.jpeg' END)"
)
_ENTRY_COLUMNS = (
    "CAST(floor(p_partkey / 500) AS BIGINT) AS archive, CAST(p_partkey AS BIGINT) AS ordinal, "
    f"concat('scans/', p_type, '/', {_ENTRY_NAME}) AS path, CAST(p_partkey * 13 % 5000 AS BIGINT) AS size"
)
_DETECTION_COLUMNS = (
    "CAST(l_orderkey AS BIGINT) AS image, CAST(l_linenumber AS BIGINT) AS ordinal, "
    "CASE WHEN l_linenumber = 7 AND l_tax = 0 THEN 0.0 ELSE l_quantity * 10 END AS width, "
    "CAST((l_partkey % 50 + 1) * 10 AS DOUBLE) AS height, l_extendedprice AS area, "
    "CAST(900 + l_suppkey % 10 * 20 AS BIGINT) AS image_width, CAST(800 AS BIGINT) AS image_height"
)
_STAGE = (
    "CASE event_type WHEN 'click' THEN 'hashing' WHEN 'view' THEN 'cropping' WHEN 'signup' THEN 'rotation_review' "
    "WHEN 'purchase' THEN 'duplicate_review' ELSE 'extracting' END"
)
_STAGE_EVENT_COLUMNS = (
    "CAST(event_id AS BIGINT) AS id, ts, CAST(user_id AS BIGINT) AS batch_id, "
    f"{_STAGE} AS stage, "
    "CASE WHEN event_id % 10 = 0 THEN 'started' WHEN value > 60 THEN 'failed' ELSE 'finished' END AS status, "
    "CASE WHEN event_id % 10 <> 0 THEN CAST(floor(value * 100) AS BIGINT) END AS duration_ms"
)
_TASK_EVENT_COLUMNS = (
    "CAST(event_id AS BIGINT) AS id, ts, CAST(user_id AS BIGINT) AS worker, "
    "CASE event_type WHEN 'purchase' THEN 'succeeded' WHEN 'error' THEN 'failed' WHEN 'signup' THEN 'retried' ELSE 'started' END AS status"
)

_SQL = {
    "batches": f"SELECT {_BATCH_COLUMNS} FROM customer UNION ALL SELECT {_UPLOAD_COLUMNS} FROM supplier",
    "scans": f"SELECT {_SCAN_COLUMNS} FROM orders",
    "crops": f"SELECT {_CROP_COLUMNS} FROM orders WHERE {_HAS_CROP}",
    "pairs": f"SELECT {_PAIR_COLUMNS.format(id=_PAIR_ID[1])} FROM ({_PAIR_KEYS.format(lineitem='lineitem')})",
    "users": "SELECT CAST(n_nationkey AS BIGINT) AS id, n_name AS name FROM nation",
    "entries": f"SELECT {_ENTRY_COLUMNS} FROM part",
    "detections": f"SELECT {_DETECTION_COLUMNS} FROM lineitem",
    "stage_events": f"SELECT {_STAGE_EVENT_COLUMNS} FROM events",
    "task_events": f"SELECT {_TASK_EVENT_COLUMNS} FROM events",
}

# Values of an 8x8 grid after clockwise quarter turns, as 0-based source positions.
def _order(turns: int) -> list[int]:
    order = list(range(64))
    for _ in range(turns):
        order = [order[(7 - i % 8) * 8 + i // 8] for i in range(64)]
    return order


def _grid_hash(turns: int) -> str:
    picks = "[" + ",".join(str(i + 1) for i in _order(turns)) + "]"
    return (
        f"list_sum(list_transform(range(64), lambda i: CASE WHEN v[({picks})[i + 1]] > m "
        "THEN (1::UBIGINT << (63 - i)::UBIGINT)::HUGEINT ELSE 0::HUGEINT END))::UBIGINT"
    )


_SQL["grids"] = (
    "SELECT vec_id AS id, label::BIGINT AS batch_id, v, (list_sort(v)[32] + list_sort(v)[33]) / 2 AS m, "
    "list_transform(v, lambda x: abs(x)) AS color FROM "
    "(SELECT vec_id, label, list_transform(embedding, lambda x: x::DOUBLE) AS v FROM embeddings)"
)
_SQL["prints"] = " UNION ALL ".join(
    f"SELECT id, batch_id, {90 * t}::BIGINT AS rotation, {_grid_hash(t)} AS hash, color FROM grids" for t in range(4)
)
_BHATTACHARYYA = (
    "sqrt(greatest(0.0, 1 - list_sum(list_transform(range(64), lambda i: sqrt(q.color[i + 1] * x.color[i + 1]))) "
    "/ sqrt(list_sum(q.color) * list_sum(x.color))))"
)
# Matching rotations of every (query, other) pair, by brute force.
_SQL["near"] = (
    "SELECT q.id AS query_id, x.id AS other_id, q.batch_id AS query_batch, x.batch_id AS other_batch, "
    "x.rotation, bit_count(xor(q.hash, x.hash))::BIGINT AS structural, q.color AS qc, x.color AS xc "
    "FROM prints q JOIN prints x ON q.id <> x.id WHERE q.rotation = 0 AND bit_count(xor(q.hash, x.hash)) <= 20"
)
_SQL["hits"] = (
    "SELECT query_id, other_id, query_batch, other_batch, structural, rotation, color FROM ("
    "SELECT *, row_number() OVER (PARTITION BY query_id, other_id ORDER BY structural, rotation) AS best FROM ("
    "SELECT *, sqrt(greatest(0.0, 1 - list_sum(list_transform(range(64), lambda i: sqrt(qc[i + 1] * xc[i + 1]))) "
    "/ sqrt(list_sum(qc) * list_sum(xc)))) AS color FROM near) WHERE color <= 0.45) WHERE best = 1"
)
_SQL["words"] = (
    "SELECT DISTINCT doc_id, unnest(string_split_regex(lower(text), '[ \\t\\n\\r]+')) AS word FROM documents"
)
_SQL["doc_hashes"] = (
    "SELECT doc_id AS id, sum(CASE WHEN 2 * ones > n THEN (1::UBIGINT << i::UBIGINT)::HUGEINT ELSE 0::HUGEINT END)::UBIGINT AS hash FROM ("
    "SELECT doc_id, i, sum((h >> i::UBIGINT) & 1::UBIGINT) AS ones, count(*) AS n FROM ("
    "SELECT doc_id, ('0x' || substr(md5(word), 1, 16))::UBIGINT AS h FROM words WHERE word <> ''), range(64) r(i) "
    "GROUP BY doc_id, i) GROUP BY doc_id"
)
_NEEDS = {"prints": ["grids"], "near": ["prints"], "hits": ["near"], "doc_hashes": ["words"]}


def with_tables(names: str, body: str) -> str:
    """SQL with the named tables (and those they need) defined in front."""
    order: list[str] = []

    def add(name: str) -> None:
        for needed in _NEEDS.get(name, []):
            add(needed)
        if name not in order:
            order.append(name)

    for name in names.split():
        add(name)
    defined = ", ".join(f"{n} AS MATERIALIZED ({_SQL[n]})" for n in order)
    return f"WITH RECURSIVE {defined} {body}" if order else body


class Tables:
    """The same tables as DataFrames."""

    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.spark = spark
        self.folder = folder

    def given(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    def spread(self, name: str) -> DataFrame:
        """A given table over all cores, also when its file is a single split.

        Large tables have splits enough and are not shuffled.
        """
        rows, cores = self.given(name), self.spark.sparkContext.defaultParallelism
        return rows if rows.rdd.getNumPartitions() >= cores else rows.repartition(cores)

    def _select(self, name: str, columns: str) -> DataFrame:
        return self.spark.sql(f"SELECT {columns} FROM {{given}}", given=self.given(name))

    @cached_property
    def batches(self) -> DataFrame:
        stamped = self._select("customer", _BATCH_COLUMNS).unionAll(
            self._select("supplier", _UPLOAD_COLUMNS)
        )
        return stamped.withColumn("created_at", F.timestamp_seconds("created_s"))

    @cached_property
    def scans(self) -> DataFrame:
        return self._select("orders", _SCAN_COLUMNS)

    @cached_property
    def crops(self) -> DataFrame:
        return self.spark.sql(
            f"SELECT {_CROP_COLUMNS} FROM {{orders}} WHERE {_HAS_CROP}", orders=self.given("orders")
        )

    @cached_property
    def candidates(self) -> DataFrame:
        return self.spark.sql(
            f"SELECT {_PAIR_COLUMNS.format(id=_PAIR_ID[0])} FROM ({_PAIR_KEYS})".replace("{lineitem}", "{rows}"),
            rows=self.given("lineitem"),
        )

    @cached_property
    def users(self) -> DataFrame:
        return self._select("nation", "CAST(n_nationkey AS BIGINT) AS id, n_name AS name")

    @cached_property
    def entries(self) -> DataFrame:
        return self._select("part", _ENTRY_COLUMNS)

    @cached_property
    def detections(self) -> DataFrame:
        return self._select("lineitem", _DETECTION_COLUMNS)

    @cached_property
    def stage_events(self) -> DataFrame:
        return self._select("events", _STAGE_EVENT_COLUMNS)

    @cached_property
    def task_events(self) -> DataFrame:
        return self._select("events", _TASK_EVENT_COLUMNS)

    @cached_property
    def attempts(self) -> DataFrame:
        return self.given("events").selectExpr("user_id AS key", "ts", "event_id AS id")

    @cached_property
    def prints(self) -> DataFrame:
        """Print rows of the embeddings; the label is the batch."""
        return self.spread("embeddings").select(
            F.col("vec_id").alias("id"),
            F.col("label").cast("long").alias("batch_id"),
            F.concat(F.lit("card-"), (F.col("vec_id") % 10).cast("string")).alias("pairing_key"),
            grid_prints(F.col("embedding"), F.transform("embedding", lambda x: F.abs(x))).alias("prints"),
        )

    @cached_property
    def doc_hashes(self) -> DataFrame:
        """One 64-bit hash per document: the majority of its words' hash bits.

        Two counters share one LONG, so 32 sums do the work of 64, and each
        document leaves its task as a single partial row.
        """
        words = (
            self.spread("documents")
            .select("doc_id", F.explode(F.array_distinct(F.split(F.lower("text"), "[ \\t\\n\\r]+"))).alias("word"))
            .filter("word <> ''")
            .selectExpr("doc_id", "cast(conv(substr(md5(word), 1, 16), 16, -10) as bigint) AS h")
        )
        sums = [
            F.expr(f"sum((shiftrightunsigned(h, {i}) & 1L) + shiftleft(shiftrightunsigned(h, {i + 32}) & 1L, 32))").alias(f"s{i}")
            for i in range(32)
        ]
        counted = words.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"), *sums)
        bits = [f"if(2 * (s{i} & 4294967295L) > n, shiftleft(1L, {i}), 0L)" for i in range(32)]
        bits += [f"if(2 * shiftrightunsigned(s{i}, 32) > n, shiftleft(1L, {i + 32}), 0L)" for i in range(32)]
        return counted.selectExpr("doc_id AS id", " | ".join(bits) + " AS hash")

    @cached_property
    def images(self) -> DataFrame:
        """16x16 images drawn from the embeddings, in the image source's struct."""
        level = F.transform("embedding", lambda x: F.greatest(F.lit(0), F.least(F.lit(255), F.floor(x * 1000))).cast("int"))
        byte = lambda v: F.lpad(F.hex(v), 2, "0")
        drawn = F.transform(
            F.sequence(F.lit(0), F.lit(255)),
            lambda i: F.get(F.col("level"), (F.floor(i / 32) * 8 + F.floor((i % 16) / 2)).cast("int")),
        )
        pixel = F.transform(
            drawn, lambda v: F.concat(byte(v), byte(F.floor(v / 2)), byte(F.floor(v / 3)))
        )
        image = F.struct(
            F.concat(F.lit("vec/"), F.col("vec_id").cast("string")).alias("origin"),
            F.lit(16).alias("height"),
            F.lit(16).alias("width"),
            F.lit(3).alias("nChannels"),
            F.lit(16).alias("mode"),
            F.unhex(F.array_join(pixel, "")).alias("data"),
        )
        rows = self.spread("embeddings").withColumn("level", level)
        return rows.select(F.col("vec_id").alias("id"), image.alias("image"))
