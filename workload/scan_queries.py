"""Geometry, fingerprints and the duplicate search."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from imprint.config import MatchConfig
from imprint.functions import bits, color
from imprint.operators import duplicates, fingerprint, geometry, similarity
from imprint.plans.duplicates import find_duplicates
from imprint.session import materialize
from workload.registry import query
from workload.tables import Tables, _order

# The default bounds leave no pair among the given embeddings.
MATCH = MatchConfig(structural_max=20, color_max=0.45)

_RATIO = "CASE WHEN least(width, height) > 0 THEN greatest(width, height) / least(width, height) ELSE 0.0 END"


@query(
    "G2",
    """SELECT image, ordinal, share <= 0.8 AS precropped, CASE WHEN share <= 0.8 THEN 0.35 ELSE 0.15 END::DOUBLE AS tolerance,
    count(*)::BIGINT AS n FROM (SELECT image, ordinal, width / 500 AS share FROM detections) GROUP BY ALL""",
    "detections",
)
def precropped_routing(t: Tables) -> DataFrame:
    precropped = geometry.is_precropped(F.col("width") / 500)
    routed = t.detections.select(
        "image", "ordinal", precropped.alias("precropped"), geometry.tolerance(precropped).alias("tolerance")
    )
    return routed.groupBy(*routed.columns).agg(F.count(F.lit(1)).alias("n"))


@query(
    "G3 G10",
    f"""SELECT image, ordinal, width, height, round({_RATIO}, 6) AS ratio, abs({_RATIO} - 1.4) <= 0.15 AS ok,
    CASE WHEN width >= height THEN 'landscape' ELSE 'portrait' END AS orientation,
    CASE WHEN width >= height THEN 1050 ELSE 750 END::BIGINT AS out_width,
    CASE WHEN width >= height THEN 750 ELSE 1050 END::BIGINT AS out_height FROM detections""",
    "detections",
)
def aspect_gate(t: Tables) -> DataFrame:
    ratio = geometry.aspect_ratio(F.col("width"), F.col("height"))
    oriented = geometry.orientation(F.col("width"), F.col("height"))
    canvas = geometry.output_canvas(oriented)
    return t.detections.select(
        "image", "ordinal", "width", "height",
        F.round(ratio, 6).alias("ratio"),
        geometry.aspect_ok(ratio, 0.15).alias("ok"),
        oriented.alias("orientation"),
        canvas["width"].cast("long").alias("out_width"),
        canvas["height"].cast("long").alias("out_height"),
    )


_BEST = f"""
SELECT image, ordinal, width, height, area, image_width, image_height, score, area_ratio FROM (
  SELECT *, row_number() OVER (PARTITION BY image ORDER BY score, area_ratio, ordinal, width, height, area, image_width) AS place FROM (
    SELECT *, CASE WHEN width > 0 AND height > 0
        THEN abs({_RATIO} - 3.5 / 2.5) + (1 - area / greatest(1, floor(max(area) OVER (PARTITION BY image)))) * 0.5
        ELSE 'Infinity'::DOUBLE END AS score,
      CASE WHEN width > 0 AND height > 0 THEN area / (image_width * image_height) ELSE 0.0 END AS area_ratio
    FROM detections WHERE area >= image_width * image_height * 0.005))
WHERE place = 1
"""


@query(
    "G4",
    f"SELECT image, ordinal, width, height, area, round(score, 6) AS score, round(area_ratio, 11) AS area_ratio FROM ({_BEST})",
    "detections",
)
def best_detection(t: Tables) -> DataFrame:
    best = geometry.best_detection(t.detections)
    return best.select(
        "image", "ordinal", "width", "height", "area",
        F.round("score", 6).alias("score"), F.round("area_ratio", 11).alias("area_ratio"),
    )


@query(
    "U3 G4",
    f"SELECT image, ordinal, width, height, area, round(score, 6) AS score FROM ({_BEST})",
    "detections",
)
def best_of_two_detectors(t: Tables) -> DataFrame:
    first = t.detections.filter("ordinal <= 3")
    second = t.detections.filter("ordinal > 3")
    best = geometry.best_detection(geometry.all_detections(first, second))
    return best.select("image", "ordinal", "width", "height", "area", F.round("score", 6).alias("score"))


@query(
    "G5",
    """SELECT image, ordinal, width, height, round(greatest(10, 0.07 * greatest(width, height)), 6) AS padding,
    round(width + 2 * greatest(10, 0.07 * greatest(width, height)), 6) AS padded_width,
    round(height + 2 * greatest(10, 0.07 * greatest(width, height)), 6) AS padded_height FROM detections""",
    "detections",
)
def padded_extent(t: Tables) -> DataFrame:
    padded = geometry.padded_sides(F.col("width"), F.col("height"))
    return t.detections.select("image", "ordinal", "width", "height", padded.alias("p")).select(
        "image", "ordinal", "width", "height",
        F.round("p.padding", 6).alias("padding"),
        F.round("p.width", 6).alias("padded_width"),
        F.round("p.height", 6).alias("padded_height"),
    )


# Four corners of a tilted rectangle, listed in an order that depends on the row.
_POINTS_SQL = """
SELECT image, ordinal, width, height, image_width, image_height,
  CASE ordinal % 4
    WHEN 0 THEN [[ox, oy], [ox + width, oy + dip], [ox + width - dip, oy + height + dip], [ox - dip, oy + height]]
    WHEN 1 THEN [[ox + width - dip, oy + height + dip], [ox - dip, oy + height], [ox, oy], [ox + width, oy + dip]]
    WHEN 2 THEN [[ox - dip, oy + height], [ox, oy], [ox + width, oy + dip], [ox + width - dip, oy + height + dip]]
    ELSE [[ox + width, oy + dip], [ox, oy], [ox - dip, oy + height], [ox + width - dip, oy + height + dip]] END AS pts
FROM (SELECT *, CAST(image % 700 - 20 AS DOUBLE) AS ox, CAST(image % 500 - 10 AS DOUBLE) AS oy,
  CAST(ordinal * 3 AS DOUBLE) AS dip FROM detections)
"""


def _points(t: Tables) -> DataFrame:
    text = _POINTS_SQL.replace("[", "array(").replace("]", ")").replace("FROM detections", "FROM {d}")
    return t.spark.sql(text, d=t.detections)


def _flat(points) -> F.Column:
    rounded = F.transform(F.flatten(points), lambda x: F.round(x, 3).cast("long").cast("string"))
    return F.array_join(rounded, ",")


_FLAT = "array_to_string(list_transform(flatten({p}), lambda x: round(x, 3)::BIGINT::VARCHAR), ',')"
_CLIPPED = (
    "list_transform(pts, lambda p: [greatest(0.0, least(p[1], image_width - 1.0)), greatest(0.0, least(p[2], image_height - 1.0))])"
)
_ORDERED = """
[list_sort(list_transform(pts, lambda p, i: {'k': p[1] + p[2], 'i': i, 'p': p}))[1].p,
 list_sort(list_transform(pts, lambda p, i: {'k': p[2] - p[1], 'i': i, 'p': p}))[1].p,
 list_sort(list_transform(pts, lambda p, i: {'k': -(p[1] + p[2]), 'i': i, 'p': p}))[1].p,
 list_sort(list_transform(pts, lambda p, i: {'k': p[1] - p[2], 'i': i, 'p': p}))[1].p]
"""


@query(
    "G5",
    f"SELECT image, ordinal, width, height, {_FLAT.format(p=_CLIPPED)} AS clipped FROM ({_POINTS_SQL})",
    "detections",
)
def clip_corners(t: Tables) -> DataFrame:
    clipped = geometry.clip_points(F.col("pts"), F.col("image_width"), F.col("image_height"))
    return _points(t).select("image", "ordinal", "width", "height", _flat(clipped).alias("clipped"))


@query(
    "G6",
    f"SELECT image, ordinal, width, height, {_FLAT.format(p='o')} AS corners FROM (SELECT *, {_ORDERED} AS o FROM ({_POINTS_SQL}))",
    "detections",
)
def order_corners(t: Tables) -> DataFrame:
    corners = geometry.order_corners(F.col("pts"))
    return _points(t).select("image", "ordinal", "width", "height", _flat(corners).alias("corners"))


@query(
    "G7 G3",
    f"""SELECT image, ordinal, width, height, round(w, 6) AS side_width, round(h, 6) AS side_height,
    round(CASE WHEN least(w, h) > 0 THEN greatest(w, h) / least(w, h) ELSE 0.0 END, 6) AS ratio,
    CASE WHEN w >= h THEN 'landscape' ELSE 'portrait' END AS orientation FROM (
      SELECT *, greatest(list_distance(o[3], o[4]), list_distance(o[2], o[1])) AS w,
        greatest(list_distance(o[2], o[3]), list_distance(o[1], o[4])) AS h
      FROM (SELECT *, {_ORDERED} AS o FROM ({_POINTS_SQL})))""",
    "detections",
)
def side_lengths(t: Tables) -> DataFrame:
    rows = _points(t).withColumn("corners", geometry.order_corners(F.col("pts")))
    rows = rows.withColumn("s", geometry.side_lengths(F.col("corners")))
    box = geometry.crop_box(F.col("pts"))
    return rows.withColumn("box", box).select(
        "image", "ordinal", "width", "height",
        F.round("s.width", 6).alias("side_width"),
        F.round("s.height", 6).alias("side_height"),
        F.round("box.aspect_ratio", 6).alias("ratio"),
        F.col("box.orientation").alias("orientation"),
    )


@query(
    "G8",
    f"""SELECT image, ordinal, width, height, round(abs(
      o[1][1] * o[2][2] - o[2][1] * o[1][2] + o[2][1] * o[3][2] - o[3][1] * o[2][2]
      + o[3][1] * o[4][2] - o[4][1] * o[3][2] + o[4][1] * o[1][2] - o[1][1] * o[4][2]) / 2 / (image_width * image_height), 11) AS share
    FROM (SELECT *, {_ORDERED} AS o FROM ({_POINTS_SQL}))""",
    "detections",
)
def polygon_share(t: Tables) -> DataFrame:
    rows = _points(t).withColumn("corners", geometry.order_corners(F.col("pts")))
    share = geometry.area_fraction(F.col("corners"), F.col("image_width"), F.col("image_height"))
    return rows.select("image", "ordinal", "width", "height", F.round(share, 11).alias("share"))


@query(
    "G9",
    f"""SELECT s.id, s.batch_id, CASE WHEN abs({_RATIO} - 1.4) <= 0.15 THEN 'cropped' ELSE 'crop_failed' END AS status,
    b.image IS NOT NULL AS has_crop FROM scans s LEFT JOIN ({_BEST}) b ON s.id = b.image""",
    "detections scans",
)
def crop_outcome(t: Tables) -> DataFrame:
    ratio = geometry.aspect_ratio(F.col("width"), F.col("height"))
    checks = geometry.best_detection(t.detections).select(
        F.col("image").alias("scan_id"), geometry.aspect_ok(ratio, 0.15).alias("aspect_ratio_ok")
    )
    return geometry.crop_outcome(t.scans, checks).select("id", "batch_id", "status", "has_crop")


@query(
    "G1",
    """SELECT id, round(count_if((1868 * v + 9617 * (v // 2) + 4899 * (v // 3) + 8192) >> 14 <= 8) / count(*), 6) AS fraction
    FROM (SELECT id, greatest(0, least(255, floor(embedding[cell + 1] * 1000)))::BIGINT AS v FROM (
      SELECT vec_id AS id, embedding, unnest(list_concat(
        list_transform(range(16), lambda i: i // 2), list_transform(range(16), lambda i: 56 + i // 2),
        list_transform(range(16), lambda i: i // 2 * 8), list_transform(range(16), lambda i: i // 2 * 8 + 7))) AS cell
      FROM embeddings)) GROUP BY id""",
)
def border_background(t: Tables) -> DataFrame:
    return fingerprint.border_background(t.images).select(
        "id", F.round("background_fraction", 6).alias("fraction")
    )


# The fingerprint of the 16x16 images, whose pixels come in blocks of two by two, from
# their 8x8 grid of levels v: pixels are (v, v // 2, v // 3), blue first.
_LEVELS = "list_transform(embedding, lambda x: greatest(0, least(255, floor(x * 1000)))::BIGINT)"


def _rows(matrix) -> str:
    return "[" + ", ".join("[" + ", ".join(f"{int(x)}::DOUBLE" if not i else str(int(x)) for i, x in enumerate(row)) + "]" for row in matrix) + "]"


def _image_prints_sql() -> str:
    # Both pixels of a block have one level, so their weights add up.
    weights = _rows(fingerprint.resampling_weights(16, fingerprint.HASH_INPUT).reshape(-1, 8, 2).sum(axis=2))
    cosines = _rows(fingerprint.cosine_weights())
    level = "greatest(0, least(255, floor((list_inner_product(w, {row}) + 2097152) / 4194304)))"
    turns = " UNION ALL ".join(
        f"SELECT id, {90 * t}::BIGINT AS rotation, list_transform({[i + 1 for i in _order(t)]}, lambda i: g[i]) AS g FROM gray" for t in range(4)
    )
    return f"""
WITH k AS MATERIALIZED (SELECT {weights} AS ws, {cosines} AS cs),
v AS MATERIALIZED (SELECT vec_id AS id, {_LEVELS} AS v FROM embeddings),
gray AS (SELECT id, list_transform(v, lambda x: ((7471 * x + 38470 * (x // 2) + 19595 * (x // 3) + 32768) >> 16)::DOUBLE) AS g FROM v),
turned AS ({turns}),
across AS (SELECT id, rotation, list_transform(range(8), lambda r: list_transform(ws, lambda w: {level.format(row='g[r * 8 + 1:r * 8 + 8]')})) AS a FROM turned, k),
small AS (SELECT id, rotation, list_transform(range(32), lambda o: list_transform(ws, lambda w: {level.format(row='list_transform(a, lambda x: x[o + 1])')})) AS s FROM across, k),
half AS (SELECT id, rotation, list_transform(s, lambda x: list_transform(cs, lambda c: list_inner_product(c, x))) AS h FROM small, k),
low AS (SELECT id, rotation, flatten(list_transform(range(8), lambda u: list_transform(cs, lambda c: list_inner_product(c, list_transform(h, lambda x: x[u + 1]))))) AS l FROM half, k),
bits AS (SELECT id, rotation, list_sum(list_transform(l, lambda x, i: CASE WHEN 2 * x > list_sort(l)[32] + list_sort(l)[33]
  THEN (1::UBIGINT << (64 - i)::UBIGINT)::HUGEINT ELSE 0::HUGEINT END))::UBIGINT AS hash FROM low),
edge AS (SELECT id, v[c.cell + 1] AS b, c.n FROM v, (SELECT unnest(range(64)) AS cell) r, LATERAL (
  SELECT r.cell AS cell, CASE WHEN (r.cell < 8 OR r.cell >= 56) AND r.cell % 8 IN (0, 7) THEN 3 WHEN r.cell < 8 OR r.cell >= 56 OR r.cell % 8 IN (0, 7) THEN 2 ELSE 0 END AS n) c),
hues AS (SELECT id, n, b, b - b // 3 AS spread, CASE WHEN b - b // 3 = 0 THEN 0 ELSE (round_even((4 + (b // 3 - b // 2) / (b - b // 3)) * 30, 0)::BIGINT % 180 + 180) % 180 END AS hue FROM edge WHERE n > 0),
cells AS (SELECT id, (hue * 16 // 180) * 8 + (CASE WHEN b = 0 THEN 0 ELSE round_even(255 * spread / b, 0)::BIGINT END) * 8 // 256 AS cell, sum(n) AS n FROM hues GROUP BY ALL),
counts AS (SELECT id, map_from_entries(list((cell, n))) AS m, max(n) AS high, CASE WHEN count(*) < 128 THEN 0 ELSE min(n) END AS low FROM cells GROUP BY id),
colors AS (SELECT id, array_to_string(list_transform(range(128), lambda i: round(((coalesce(m[i], 0) - low)::DOUBLE / (high - low))::FLOAT::DOUBLE, 6)::DECIMAL(10,6)::VARCHAR), ',') AS colors FROM counts)
SELECT b.id, b.rotation, lpad(lower(to_hex(b.hash)), 16, '0') AS hash, c.colors FROM bits b JOIN colors c ON c.id = b.id
"""


@query("F1 F3 F4 X3", _image_prints_sql())
def fingerprint_images(t: Tables) -> DataFrame:
    """Hash and colours of drawn images at four rotations."""
    prints = fingerprint.fingerprint_images(t.images)
    one = prints.select("id", F.inline("prints"))
    share = lambda x: F.round(x.cast("double"), 6).cast("decimal(10,6)").cast("string")
    return one.select(
        "id",
        F.col("rotation").cast("long").alias("rotation"),
        bits.hash_to_hex(F.col("hash")).alias("hash"),
        F.array_join(F.transform("color", share), ",").alias("colors"),
    )


@query(
    "F2 F4",
    "SELECT id, rotation, lpad(lower(to_hex(hash)), 16, '0') AS hash FROM prints",
    "prints",
)
def median_bit_prints(t: Tables) -> DataFrame:
    one = t.prints.select("id", F.inline("prints"))
    return one.select("id", F.col("rotation").cast("long").alias("rotation"), bits.hash_to_hex(F.col("hash")).alias("hash"))


@query(
    "F5",
    """SELECT c.id, s.batch_id, coalesce(c.rotation_degrees, 0)::BIGINT AS rotation FROM crops c JOIN scans s ON c.raw_scan_id = s.id
    WHERE s.side = 'front' AND c.r2_key_cropped IS NOT NULL""",
    "crops scans",
)
def eligible_crops(t: Tables) -> DataFrame:
    rotation = F.coalesce("rotation_degrees", F.lit(0)).cast("long").alias("rotation")
    return fingerprint.eligible_crops(t.crops, t.scans).select("id", "batch_id", rotation)


@query(
    "M1",
    """SELECT a.vec_id AS id, bit_count(xor(h.hash, g.hash))::BIGINT AS distance FROM embeddings a
    JOIN prints h ON h.id = a.vec_id AND h.rotation = 0 JOIN prints g ON g.id = a.vec_id AND g.rotation = 180""",
    "prints",
)
def hamming_distance(t: Tables) -> DataFrame:
    """Distance of each print to itself upside down."""
    upright, turned = (duplicates.print_at(F.col("prints"), r)["hash"] for r in (0, 180))
    return t.prints.select("id", bits.hamming(upright, turned).cast("long").alias("distance"))


@query(
    "M2",
    """SELECT vec_id AS id, round(sqrt(greatest(0.0, 1 - list_sum(list_transform(range(64), lambda i:
      sqrt(abs(e[i + 1]) * abs(e[64 - i])))) / list_sum(list_transform(e, lambda x: abs(x))))), 5) AS distance
    FROM (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings)""",
)
def bhattacharyya_distance(t: Tables) -> DataFrame:
    """Distance of each histogram to its own reverse."""
    sizes = F.transform("embedding", lambda x: F.abs(x.cast("double")))
    distance = color.bhattacharyya(sizes, F.reverse(sizes))
    return t.given("embeddings").select(F.col("vec_id").alias("id"), F.round(distance, 5).alias("distance"))


@query(
    "J11 U4",
    """SELECT query_id, other_id, min(structural)::BIGINT AS distance FROM near GROUP BY 1, 2""",
    "near",
)
def hamming_radius_join(t: Tables) -> DataFrame:
    """Any rotation of the other side, radius 20."""
    turned = t.prints.select("id", F.inline("prints"))
    pairs = similarity.hamming_join(turned.filter("rotation = 0"), turned, 20, nearest="id")
    return pairs.filter("left_id <> right_id").select(
        F.col("left_id").alias("query_id"), F.col("right_id").alias("other_id"), F.col("distance").cast("long").alias("distance")
    )


@query(
    "J11",
    """SELECT a.id AS left_id, b.id AS right_id, bit_count(xor(a.hash, b.hash))::BIGINT AS distance
    FROM doc_hashes a JOIN doc_hashes b ON a.id < b.id WHERE bit_count(xor(a.hash, b.hash)) <= 10""",
    "doc_hashes",
)
def document_hash_join(t: Tables) -> DataFrame:
    """Radius 10 over one hash per document."""
    pairs = similarity.hamming_self_join(t.doc_hashes, 10)
    return pairs.withColumn("distance", F.col("distance").cast("long"))


@query(
    "X1",
    """SELECT a.id AS left_id, b.id AS right_id, levenshtein(a.v, b.v)::BIGINT AS distance
    FROM (SELECT p_partkey AS id, p_name AS v, p_brand, p_size FROM part) a
    JOIN (SELECT p_partkey AS id, p_name AS v, p_brand, p_size FROM part) b
    ON a.p_brand = b.p_brand AND a.p_size = b.p_size AND a.id < b.id WHERE levenshtein(a.v, b.v) <= 3""",
)
def metric_join(t: Tables) -> DataFrame:
    """Another metric: edit distance of part names, among parts of one brand and size."""
    parts = t.given("part").selectExpr("p_partkey AS id", "p_name AS value", "p_brand", "p_size")

    # A fixed number of tasks, for a few megabytes of parts are many pairs.
    tasks = 8 * t.spark.sparkContext.defaultParallelism

    def same_kind(left: DataFrame, right: DataFrame) -> DataFrame:
        kind = ["p_brand", "p_size"]
        sides = []
        for side, rows in (("left", left), ("right", right)):
            ids = rows.select(F.col("id").alias(f"{side}_id"), *kind)
            # A part that comes twice is tested by each of its names.
            named = ids.join(rows.select(F.col("id").alias(f"{side}_id"), F.col("value").alias(f"{side}_value")), f"{side}_id")
            sides.append(named.repartition(tasks, *kind))
        return sides[0].join(sides[1], kind).filter("left_id < right_id")

    def edits(a: F.Column, b: F.Column) -> F.Column:
        # Beyond the bound counting stops, and the pair is no match.
        return F.nullif(F.levenshtein(a, b, 3), F.lit(-1))

    joined = similarity.similarity_join(parts, parts, edits, 3, same_kind)
    return joined.withColumn("distance", F.col("distance").cast("long"))


_POINT = "[p_size::DOUBLE, p_retailprice::DOUBLE]"
_L1 = "abs(a.v[1] - b.v[1]) + abs(a.v[2] - b.v[2])"


@query(
    "X1",
    f"""SELECT a.id AS left_id, b.id AS right_id, round({_L1}, 6) AS distance
    FROM (SELECT p_partkey AS id, {_POINT} AS v FROM part) a JOIN (SELECT p_partkey AS id, {_POINT} AS v FROM part) b
    ON a.id < b.id AND abs(a.v[1] - b.v[1]) <= 1.05 WHERE {_L1} <= 1.05""",
)
def metric_self_join(t: Tables) -> DataFrame:
    """A metric of points, size and price of all parts with all, without any key."""
    def l1(a: F.Column, b: F.Column) -> F.Column:
        return F.aggregate(F.zip_with(a, b, lambda x, y: F.abs(x - y)), F.lit(0.0), lambda total, x: total + x)

    points = t.spread("part").selectExpr("p_partkey AS id", "array(cast(p_size AS double), cast(p_retailprice AS double)) AS value")
    return similarity.metric_self_join(points, l1, 1.05).withColumn("distance", F.round("distance", 6))


_HIT_COLUMNS = "query_id, other_id, structural, rotation, round(color, 5) AS color"


def _hit_columns(hits: DataFrame) -> DataFrame:
    return hits.select(
        "query_id", "other_id",
        F.col("structural").cast("long").alias("structural"),
        F.col("rotation").cast("long").alias("rotation"),
        F.round("color", 5).alias("color"),
    )


@query(
    "J12 M3",
    f"SELECT {_HIT_COLUMNS} FROM hits WHERE query_id > other_id AND query_batch = other_batch",
    "hits",
)
def within_batch_duplicates(t: Tables) -> DataFrame:
    return _hit_columns(duplicates.within_batch_hits(t.prints, MATCH))


@query(
    "J13 M3",
    f"SELECT {_HIT_COLUMNS} FROM hits WHERE query_id > other_id AND query_batch <> other_batch",
    "hits",
)
def cross_batch_duplicates(t: Tables) -> DataFrame:
    return _hit_columns(duplicates.cross_batch_hits(t.prints, MATCH))


@query("U1 M3", f"SELECT {_HIT_COLUMNS} FROM hits WHERE query_id > other_id", "hits")
def all_duplicates(t: Tables) -> DataFrame:
    return _hit_columns(duplicates.all_hits(t.prints, config=MATCH))


# Classes of equal prints by brute force: the least id with the same four hashes and histogram.
_CLASSES = """
SELECT g.id, g.batch_id, min(o.id) OVER (PARTITION BY {part}g.v) AS class_id, count(*) OVER (PARTITION BY {part}g.v)::BIGINT AS class_size,
  coalesce(n.links, 0)::BIGINT AS links
FROM grids g JOIN grids o ON o.id = g.id LEFT JOIN (
  SELECT id, count(DISTINCT other) AS links FROM (
    SELECT query_id AS id, other_id AS other FROM hits {where} UNION ALL SELECT other_id, query_id FROM hits {where}) GROUP BY id
) n ON n.id = g.id
"""


@query("U1 J12 J13", _CLASSES.format(part="", where=""), "hits")
def duplicate_classes(t: Tables) -> DataFrame:
    """One row for every row: its class of equal prints, and how many rows it is linked to."""
    return duplicates.duplicate_classes(t.prints, MATCH).rows()


@query("J12", _CLASSES.format(part="g.batch_id, ", where="WHERE query_batch = other_batch"), "hits")
def within_batch_classes(t: Tables) -> DataFrame:
    return duplicates.duplicate_classes(t.prints, MATCH, ["batch_id"]).rows()


@query("M3", f"SELECT {_HIT_COLUMNS} FROM hits", "hits")
def best_rotation(t: Tables) -> DataFrame:
    """All pairs within the radius, verified over four rotations where they are made."""
    upright = duplicates.print_at(F.col("prints"), 0)
    rows = materialize(t.prints.withColumn("row", F.monotonically_increasing_id()))
    queries = rows.select("id", "row", upright["hash"].alias("hash"), upright["color"].alias("c"))
    turned = rows.select("id", "row", "prints", F.explode("prints.hash").alias("hash"))
    # The prints of both rows of a pair are there where it is made, and do not come with it.
    best = duplicates.BestMatch("hash", "c", "prints", MATCH)
    matched = similarity.hamming_join(queries, turned, 20, nearest="row", verify=best).filter("left_id <> right_id")
    return _hit_columns(matched.select(F.col("left_id").alias("query_id"), F.col("right_id").alias("other_id"), "match.*"))


@query(
    "J9",
    """SELECT DISTINCT n.query_batch AS query_batch_id, n.other_id AS id, n.other_batch AS batch_id FROM near n
    WHERE n.query_batch <> n.other_batch""",
    "near",
)
def shortlist_other_batches(t: Tables) -> DataFrame:
    from imprint.operators.catalog import shortlist

    turned = t.prints.select("id", "batch_id", F.inline("prints"))
    owners = t.prints.select("id", F.col("batch_id").alias("query_batch_id"))
    upright = turned.filter("rotation = 0").select("id", "hash").join(owners, "id")
    near = similarity.hamming_join(upright, turned, 20, left_columns=["query_batch_id"]).filter("left_id <> right_id")
    matched = near.select(F.col("left_query_batch_id").alias("query_batch_id"), F.col("right_id").alias("other_id"))
    return shortlist(t.prints.select("id", "batch_id"), matched).select("query_batch_id", "id", "batch_id")


_NEW_PAIRS = """
SELECT other_id AS card_crop_id_a, query_id AS card_crop_id_b, structural::DOUBLE AS structural_score,
  round(color, 5) AS color_score, rotation AS matched_rotation, query_id % 10 = other_id % 10 AS filename_match,
  'pending' AS status
FROM hits WHERE query_id > other_id
"""


def _pair_columns(pairs: DataFrame) -> DataFrame:
    return pairs.withColumns(
        {"color_score": F.round("color_score", 5), "matched_rotation": F.col("matched_rotation").cast("long")}
    )


@query("C1 M4 M5 M6", _NEW_PAIRS, "hits")
def find_new_duplicates(t: Tables) -> DataFrame:
    """The flagship: fingerprints to candidate pairs, within and across batches."""
    return _pair_columns(find_duplicates(t.prints, config=MATCH))


_LETTERS = "abcdefghijklmnopqrstuvwxyz"
_LETTER_COUNTS = ", ".join(f"length(t) - length(replace(t, '{c}', ''))" for c in _LETTERS)
_LETTER_DISTANCE = (
    "sqrt(greatest(0.0, 1 - list_sum(list_transform(range(26), lambda i: sqrt(a.c[i + 1]::DOUBLE * b.c[i + 1]))) "
    "/ sqrt(list_sum(a.c)::DOUBLE * list_sum(b.c))))"
)


@query(
    "C1 J11 M2 M5",
    f"""SELECT a.id AS card_crop_id_a, b.id AS card_crop_id_b, bit_count(xor(a.hash, b.hash))::DOUBLE AS structural_score,
    round({_LETTER_DISTANCE}, 5) AS color_score, 0::BIGINT AS matched_rotation, a.source IS NOT DISTINCT FROM b.source AS filename_match, 'pending' AS status
    FROM shown a JOIN shown b ON a.id < b.id WHERE bit_count(xor(a.hash, b.hash)) <= 10 AND list_sum(a.c) * list_sum(b.c) > 0 AND {_LETTER_DISTANCE} <= 0.2""".replace(
        "shown", f"""(SELECT h.id, h.hash, d.source, d.c FROM doc_hashes h JOIN (SELECT doc_id, source, [{_LETTER_COUNTS}] AS c
        FROM (SELECT doc_id, source, lower(text) AS t FROM documents)) d ON d.doc_id = h.id)"""
    ),
    "doc_hashes",
)
def document_duplicates(t: Tables) -> DataFrame:
    """The whole search at its default bounds: documents by hash and letter histogram."""
    counts = [f"length(t) - length(replace(t, '{c}', ''))" for c in _LETTERS]
    letters = t.spread("documents").selectExpr("doc_id AS id", "source AS pairing_key", "lower(text) AS t").selectExpr(
        "id", "pairing_key", f"cast(array({', '.join(counts)}) AS array<float>) AS color"
    )
    prints = t.doc_hashes.join(letters, "id").select(
        "id", (F.col("id") % 10).alias("batch_id"), "pairing_key",
        F.array(F.struct(F.lit(0).alias("rotation"), "hash", "color")).alias("prints"),
    )
    return _pair_columns(find_duplicates(prints))


@query("J14", f"{_NEW_PAIRS} AND query_batch <> other_batch", "hits")
def insert_if_absent(t: Tables) -> DataFrame:
    """With all pairs inside a batch already recorded and rejected."""
    pairs = duplicates.canonical_pairs(duplicates.all_hits(t.prints, config=MATCH), duplicates.ids_once(t.prints))
    known = pairs.filter("same_batch").withColumn("status", F.lit("rejected"))
    return _pair_columns(duplicates.emit_candidates(duplicates.insert_if_absent(pairs, known)))


@query(
    "C1 T1",
    f"""SELECT * FROM ({_NEW_PAIRS}) WHERE card_crop_id_b >= (SELECT count(*) // 2 FROM embeddings)""",
    "hits",
)
def find_duplicates_against_history(t: Tables) -> DataFrame:
    """The later half of all prints as new arrivals; the earlier half as history."""
    half = t.given("embeddings").agg(F.expr("count(*) div 2").alias("half"))
    rows = t.prints.join(F.broadcast(half))
    new = rows.filter("id >= half").drop("half")
    history = rows.filter("id < half").drop("half")
    return _pair_columns(find_duplicates(new, history, config=MATCH))


@query(
    "U4",
    "SELECT DISTINCT query_id, other_id FROM near WHERE query_id > other_id",
    "near",
)
def matched_ids(t: Tables) -> DataFrame:
    turned = t.prints.select("id", F.inline("prints"))
    near = similarity.hamming_join(turned.filter("rotation = 0"), turned, 20, nearest="id").filter("left_id > right_id")
    return duplicates.matched_ids(near.selectExpr("left_id AS query_id", "right_id AS other_id"), once=True)
