"""Box queries; boxes are derived from `lineitem`: an order is an image, a box for each line."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from galleria.functions import geometry as G
from galleria.operators import boxes as B
from galleria.plans.registry import query, table

KEYED = """WITH raw AS (SELECT DISTINCT l_orderkey AS image, (((l_partkey % 60) * 60 + l_suppkey % 60) * 10 + l_linenumber) * 100000000000 + l_orderkey * 100 + CAST(l_quantity AS BIGINT) AS id, CAST(l_quantity / 50 AS DOUBLE) AS score,
  CAST(l_partkey % 60 AS DOUBLE) AS x1, CAST(l_suppkey % 60 AS DOUBLE) AS y1, CAST(l_partkey % 60 + 10 + l_linenumber * 5 AS DOUBLE) AS x2, CAST(l_suppkey % 60 + 12 + l_quantity / 2 AS DOUBLE) AS y2 FROM lineitem),
boxes AS (SELECT * FROM raw WHERE score >= 0.5 QUALIFY row_number() OVER (PARTITION BY image ORDER BY score DESC, id) <= 2000) """
IOU = """CASE WHEN (a.x2-a.x1+1)*(a.y2-a.y1+1) + (b.x2-b.x1+1)*(b.y2-b.y1+1) - greatest(0, least(a.x2,b.x2)-greatest(a.x1,b.x1)+1)*greatest(0, least(a.y2,b.y2)-greatest(a.y1,b.y1)+1) > 0
 THEN greatest(0, least(a.x2,b.x2)-greatest(a.x1,b.x1)+1)*greatest(0, least(a.y2,b.y2)-greatest(a.y1,b.y1)+1) / ((a.x2-a.x1+1)*(a.y2-a.y1+1) + (b.x2-b.x1+1)*(b.y2-b.y1+1) - greatest(0, least(a.x2,b.x2)-greatest(a.x1,b.x1)+1)*greatest(0, least(a.y2,b.y2)-greatest(a.y1,b.y1)+1)) ELSE 0 END"""


def boxes(spark: SparkSession, d: str) -> DataFrame:
    """image, id, score, box."""
    x, y = (F.col("l_partkey") % 60).cast("double"), (F.col("l_suppkey") % 60).cast("double")
    box = F.struct(x.alias("x1"), y.alias("y1"), (x + 10 + F.col("l_linenumber") * 5).alias("x2"), (y + 12 + F.col("l_quantity") / 2).alias("y2"))
    rows = table(spark, d, "lineitem")
    # Lines have no unique key; the id is made of the corner, the order and the quantity.
    key = (((F.col("l_partkey") % 60) * 60 + F.col("l_suppkey") % 60) * 10 + F.col("l_linenumber")) * 100000000000 + F.col("l_orderkey") * 100 + F.col("l_quantity").cast("long")
    return rows.select(F.col("l_orderkey").alias("image"), key.alias("id"), (F.col("l_quantity") / 50).alias("score"), box.alias("box")).distinct()


def corners(rows: DataFrame, *more: str) -> DataFrame:
    return rows.select("image", "id", *more, *[F.col(f"box.{c}").alias(c) for c in ("x1", "y1", "x2", "y2")])


@query(KEYED + f"SELECT a.image, a.id AS a, b.id AS b, round({IOU}, 6) AS iou FROM boxes a JOIN boxes b ON a.image = b.image AND a.id < b.id WHERE {IOU} > 0")
def iou_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = B.candidates(boxes(spark, sf_dir), "image")
    x, y = b.select("image", F.col("id").alias("a"), F.col("box").alias("u")), b.select("image", F.col("id").alias("b"), F.col("box").alias("v"))
    pairs = x.join(y, "image").where("a < b").withColumn("iou", G.iou(F.col("u"), F.col("v"))).where("iou > 0")
    return pairs.select("image", "a", "b", F.round("iou", 6).alias("iou"))


@query(KEYED + f"SELECT image, id, score, x1, y1, x2, y2 FROM boxes b WHERE NOT EXISTS (SELECT 1 FROM boxes a WHERE a.image = b.image AND (a.score > b.score OR a.score = b.score AND a.id < b.id) AND {IOU} > 0.4)")
def nms_oneshot(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corners(B.nms(B.candidates(boxes(spark, sf_dir), "image"), "image", mode="oneshot"), "score")


@query(KEYED.replace("WITH raw", "WITH RECURSIVE raw") + f""", ranked AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY image ORDER BY score DESC, id) AS n FROM boxes),
walk AS (SELECT image, n, id, true AS stays, [struct_pack(x1 := x1, y1 := y1, x2 := x2, y2 := y2)] AS kept FROM ranked WHERE n = 1 UNION ALL
  SELECT image, n, id, stays, CASE WHEN stays THEN list_append(kept, struct_pack(x1 := x1, y1 := y1, x2 := x2, y2 := y2)) ELSE kept END FROM (
    SELECT b.*, w.kept, NOT EXISTS (SELECT 1 FROM (SELECT unnest(w.kept, recursive := true)) a WHERE {IOU} > 0.4) AS stays FROM walk w JOIN ranked b ON b.image = w.image AND b.n = w.n + 1))
SELECT image, id, score, x1, y1, x2, y2 FROM walk JOIN ranked USING (image, n, id) WHERE stays""")
def nms_greedy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each box depends on those kept before it; the SQL walks each image's boxes from the best one on."""
    return corners(B.nms(B.candidates(boxes(spark, sf_dir), "image"), "image"), "score")


@query(KEYED + f"""SELECT a.image, a.id AS left_id, r.id AS right_id, r.iou FROM (SELECT * FROM boxes WHERE id // 100000000000 % 2 = 0) a LEFT JOIN LATERAL (
  SELECT b.id, round({IOU}, 6) AS iou FROM boxes b WHERE b.image = a.image AND b.id // 100000000000 % 2 = 1 AND {IOU} > 0 ORDER BY {IOU} DESC, b.id LIMIT 1) r ON true""")
def box_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each box of an even line the box of an odd line of its image that overlaps it most."""
    b = B.candidates(boxes(spark, sf_dir), "image")
    odd = F.floor(F.col("id") / 100000000000) % 2 == 1
    return B.best_match(b.where(~odd), b.where(odd), "image").select("image", "left_id", "right_id", F.round("iou", 6).alias("iou"))


@query(KEYED + "SELECT image, id, round((x2 - x1) * (y2 - y1), 6) AS area FROM boxes QUALIFY row_number() OVER (PARTITION BY image ORDER BY (x2 - x1) * (y2 - y1) DESC, id) = 1")
def largest_box(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = B.largest(B.candidates(boxes(spark, sf_dir), "image"), "image")
    return rows.select("image", "id", F.round(G.area(F.col("box")), 6).alias("area"))


@query(KEYED + "SELECT image, id, round(least(80, greatest(0, x1 * 1.25)), 6) AS x1, round(least(70, greatest(0, y1 * 1.5)), 6) AS y1, round(least(80, greatest(0, x2 * 1.25)), 6) AS x2, round(least(70, greatest(0, y2 * 1.5)), 6) AS y2 FROM boxes")
def scale_clip(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = B.candidates(boxes(spark, sf_dir), "image")
    scaled = b.withColumn("box", G.scale_clip(F.col("box"), F.lit(1.25), F.lit(1.5), F.lit(80.0), F.lit(70.0)))
    return corners(scaled).select("image", "id", *[F.round(c, 6).alias(c) for c in ("x1", "y1", "x2", "y2")])


ANCHORED = """WITH grid AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice, CASE l_linenumber % 3 WHEN 0 THEN 8 WHEN 1 THEN 16 ELSE 32 END AS stride, l_partkey % 80 AS i, l_suppkey % 80 AS j, l_quantity / 10 AS q, l_discount + 0.0 AS d, l_tax + 0.0 AS t FROM lineitem) """


@query(ANCHORED + "SELECT l_orderkey, l_linenumber, stride, round(i * stride - q * stride, 6) + 0.0 AS x1, round(j * stride - d * stride, 6) + 0.0 AS y1, round(i * stride + t * stride, 6) + 0.0 AS x2, round(j * stride + q * stride, 6) + 0.0 AS y2 FROM grid")
def decode_scrfd(spark: SparkSession, sf_dir: str) -> DataFrame:
    stride = F.element_at(F.array(*map(F.lit, (8, 16, 32))), (F.col("l_linenumber") % 3 + 1).cast("int"))
    rows = table(spark, sf_dir, "lineitem").withColumn("stride", stride)
    q = F.col("l_quantity") / 10
    b = G.decode_distances((F.col("l_partkey") % 80 * F.col("stride")).cast("double"), (F.col("l_suppkey") % 80 * F.col("stride")).cast("double"), F.col("stride"), q, F.col("l_discount") + 0.0, F.col("l_tax") + 0.0, q)
    return rows.select("l_orderkey", "l_linenumber", "stride", b.alias("b")).select("l_orderkey", "l_linenumber", "stride", *[(F.round(f"b.{c}", 6) + 0.0).alias(c) for c in ("x1", "y1", "x2", "y2")])


@query(ANCHORED + """, p AS (SELECT *, (i + 0.5) * stride / 640 AS cx, (j + 0.5) * stride / 640 AS cy, 64 / 640 AS w, 64 / 640 AS h FROM grid),
  o AS (SELECT *, cx + q * 0.1 * w AS ox, cy + d * 0.1 * h AS oy, w * exp(t * 0.2) AS ow, h * exp(q * 0.2) AS oh FROM p)
  SELECT l_orderkey, l_linenumber, round(least(1, greatest(0, ox - ow / 2)), 6) AS x1, round(least(1, greatest(0, oy - oh / 2)), 6) AS y1, round(least(1, greatest(0, ox + ow / 2)), 6) AS x2, round(least(1, greatest(0, oy + oh / 2)), 6) AS y2 FROM o""")
def decode_retinaface(spark: SparkSession, sf_dir: str) -> DataFrame:
    stride = F.element_at(F.array(*map(F.lit, (8, 16, 32))), (F.col("l_linenumber") % 3 + 1).cast("int"))
    prior = F.struct(((F.col("l_partkey") % 80 + 0.5) * stride / 640).alias("cx"), ((F.col("l_suppkey") % 80 + 0.5) * stride / 640).alias("cy"), F.lit(64 / 640).alias("w"), F.lit(64 / 640).alias("h"))
    q = F.col("l_quantity") / 10
    rows = table(spark, sf_dir, "lineitem").withColumn("p", prior)
    b = G.decode_offsets(F.col("p"), q, F.col("l_discount") + 0.0, F.col("l_tax") + 0.0, q)
    return rows.select("l_orderkey", "l_linenumber", b.alias("b")).select("l_orderkey", "l_linenumber", *[(F.round(f"b.{c}", 6) + 0.0).alias(c) for c in ("x1", "y1", "x2", "y2")])


#: Five points of each line: k-th offsets from its quantity, discount and tax.
POINTS = "range(1, 6) AS r(k)"


@query(ANCHORED + f"SELECT l_orderkey, l_linenumber, CAST(k - 1 AS BIGINT) AS place, round(i * stride + q * k * stride, 6) + 0.0 AS x, round(j * stride + (d - t * k) * stride, 6) + 0.0 AS y FROM grid, {POINTS}")
def decode_scrfd_landmarks(spark: SparkSession, sf_dir: str) -> DataFrame:
    stride = F.element_at(F.array(*map(F.lit, (8, 16, 32))), (F.col("l_linenumber") % 3 + 1).cast("int"))
    offsets = F.transform(F.sequence(F.lit(1), F.lit(5)), lambda k: F.array(F.col("l_quantity") / 10 * k, F.col("l_discount") - F.col("l_tax") * k))
    rows = table(spark, sf_dir, "lineitem").withColumn("stride", stride)
    points = G.decode_points((F.col("l_partkey") % 80 * F.col("stride")).cast("double"), (F.col("l_suppkey") % 80 * F.col("stride")).cast("double"), F.col("stride"), offsets)
    return _points(rows.select("l_orderkey", "l_linenumber", F.posexplode(points).alias("place", "p")))


@query(ANCHORED + f"SELECT l_orderkey, l_linenumber, CAST(k - 1 AS BIGINT) AS place, round((i + 0.5) * stride / 640 + q * k * 0.1 * (64 / 640), 6) + 0.0 AS x, round((j + 0.5) * stride / 640 + (d - t * k) * 0.1 * (64 / 640), 6) + 0.0 AS y FROM grid, {POINTS}")
def decode_retinaface_landmarks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Unlike boxes, points aren't clipped."""
    stride = F.element_at(F.array(*map(F.lit, (8, 16, 32))), (F.col("l_linenumber") % 3 + 1).cast("int"))
    prior = F.struct(((F.col("l_partkey") % 80 + 0.5) * stride / 640).alias("cx"), ((F.col("l_suppkey") % 80 + 0.5) * stride / 640).alias("cy"), F.lit(64 / 640).alias("w"), F.lit(64 / 640).alias("h"))
    offsets = F.transform(F.sequence(F.lit(1), F.lit(5)), lambda k: F.array(F.col("l_quantity") / 10 * k, F.col("l_discount") - F.col("l_tax") * k))
    rows = table(spark, sf_dir, "lineitem").withColumn("p", prior)
    return _points(rows.select("l_orderkey", "l_linenumber", F.posexplode(G.decode_point_offsets(F.col("p"), offsets)).alias("place", "p")))


def _points(rows: DataFrame) -> DataFrame:
    return rows.select("l_orderkey", "l_linenumber", F.col("place").cast("long").alias("place"), *[(F.round(F.col("p")[i], 6) + 0.0).alias(c) for i, c in enumerate("xy")])


@query("""SELECT l_orderkey, l_linenumber, l_partkey, round(640.0 / greatest(w, h), 6) AS scale, CAST(round_even(w * (640.0::DOUBLE / greatest(w, h)), 0) AS INTEGER) AS width, CAST(round_even(h * (640.0::DOUBLE / greatest(w, h)), 0) AS INTEGER) AS height
  FROM (SELECT l_orderkey, l_linenumber, l_partkey, CAST(l_partkey % 900 + 100 AS DOUBLE) AS w, CAST(l_suppkey % 70 * 10 + 90 AS DOUBLE) AS h FROM lineitem)""")
def letterbox(spark: SparkSession, sf_dir: str) -> DataFrame:
    box = G.letterbox((F.col("l_partkey") % 900 + 100).cast("double"), (F.col("l_suppkey") % 70 * 10 + 90).cast("double"), 640)
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", box.alias("b")).select("l_orderkey", "l_linenumber", "l_partkey", F.round("b.scale", 6).alias("scale"), "b.width", "b.height")


TX, TY = ([p[i] for p in G.TEMPLATE] for i in (0, 1))


@query(f"""WITH e AS (SELECT vec_id, [CAST(x AS DOUBLE) * 100 FOR x IN embedding[1:5]] AS xs, [CAST(x AS DOUBLE) * 100 FOR x IN embedding[6:10]] AS ys, {TX} AS us, {TY} AS vs FROM embeddings),
  m AS (SELECT *, list_sum(xs) / 5 AS mx, list_sum(ys) / 5 AS my, list_sum(us) / 5 AS ux, list_sum(vs) / 5 AS uy FROM e),
  s AS (SELECT *, list_sum([(xs[i] - mx) * (xs[i] - mx) + (ys[i] - my) * (ys[i] - my) FOR i IN range(1, 6)]) AS d,
    list_sum([(xs[i] - mx) * (us[i] - ux) + (ys[i] - my) * (vs[i] - uy) FOR i IN range(1, 6)]) AS p, list_sum([(xs[i] - mx) * (vs[i] - uy) - (ys[i] - my) * (us[i] - ux) FOR i IN range(1, 6)]) AS q FROM m)
  SELECT vec_id, round(p / d, 5) + 0.0 AS a, round(q / d, 5) + 0.0 AS b, round(ux - p / d * mx + q / d * my, 4) + 0.0 AS tx, round(uy - q / d * mx - p / d * my, 4) + 0.0 AS ty FROM s""")
def similarity_transform(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings").withColumn("v", F.col("embedding").cast("array<double>"))
    marks = F.array(*[F.array(F.col("v")[i] * 100, F.col("v")[i + 5] * 100) for i in range(5)])
    rows = e.select("vec_id", marks.alias("m")).select("vec_id", G.similarity_transform(F.col("m")).alias("t"))
    return rows.select("vec_id", *[(F.round(f"t.{c}", n) + 0.0).alias(c) for c, n in (("a", 5), ("b", 5), ("tx", 4), ("ty", 4))])
