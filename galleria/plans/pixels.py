"""Pixel queries: vectors of `embeddings` stand in for small images."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from galleria.functions import geometry as G, pixels as P
from galleria.plans.registry import query, table

INPUTS = {"detector": P.DETECTOR, "recognizer": P.RECOGNIZER, "detector_bgr": P.DETECTOR_BGR}
PLANES = " UNION ALL ".join(f"SELECT '{name}' AS model, {n} AS plane, {m.channels[n]} AS channel, {m.means[n]} AS mean, {m.divisors[n]} AS divisor" for name, m in INPUTS.items() for n in range(3))


@query(f"""WITH planes AS ({PLANES})
SELECT vec_id, model, CAST(plane * 25 + y * 5 + x AS BIGINT) AS place,
  round(((CASE WHEN y < 4 THEN round(CAST(embedding[(y * 5 + x) * 3 + channel + 1] AS DOUBLE) * 127 + 128) ELSE 0 END) - mean) / divisor, 6) + 0.0 AS value
FROM embeddings, planes, range(5) AS u(y), range(5) AS v(x)""")
def pixel_normalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors as RGB images of 4 x 5 pixels, padded to a square, as the inputs of three models."""
    rgb = F.transform(F.slice("embedding", 1, 60), lambda x: F.round(x.cast("double") * 127 + 128))
    images = table(spark, sf_dir, "embeddings").select("vec_id", P.padded(rgb, 4, 5, 5).alias("p"))
    models = F.create_map(*[x for name, m in INPUTS.items() for x in (F.lit(name), P.normalized(F.col("p"), 5, 5, m))])
    rows = images.select("vec_id", F.explode(models).alias("model", "values"))
    return rows.select("vec_id", "model", F.posexplode("values").alias("place", "value")).select("vec_id", "model", F.col("place").cast("long").alias("place"), (F.round("value", 6) + 0.0).alias("value"))


SIDE = 16
US, VS = ([p[i] for p in G.TEMPLATE] for i in (0, 1))


def _pixel(y: str, x: str) -> str:
    return f"(CASE WHEN {y} BETWEEN 0 AND 7 AND {x} BETWEEN 0 AND 7 THEN CAST(embedding[CAST({y} * 8 + {x} AS INTEGER) + 1] AS DOUBLE) * 100 ELSE 0 END)"


@query(f"""WITH e AS (SELECT vec_id, embedding, [3.5 + 12 * CAST(x AS DOUBLE) FOR x IN embedding[1:5]] AS xs, [3.5 + 12 * CAST(x AS DOUBLE) FOR x IN embedding[6:10]] AS ys, {US} AS us, {VS} AS vs FROM embeddings),
  m AS (SELECT *, list_sum(xs) / 5 AS mx, list_sum(ys) / 5 AS my, list_sum(us) / 5 AS ux, list_sum(vs) / 5 AS uy FROM e),
  s AS (SELECT *, list_sum([(xs[i] - mx) * (xs[i] - mx) + (ys[i] - my) * (ys[i] - my) FOR i IN range(1, 6)]) AS d,
    list_sum([(xs[i] - mx) * (us[i] - ux) + (ys[i] - my) * (vs[i] - uy) FOR i IN range(1, 6)]) AS p, list_sum([(xs[i] - mx) * (vs[i] - uy) - (ys[i] - my) * (us[i] - ux) FOR i IN range(1, 6)]) AS q FROM m),
  t AS (SELECT vec_id, embedding, p / d * {SIDE} / 112 AS a, q / d * {SIDE} / 112 AS b, (ux - p / d * mx + q / d * my) * {SIDE} / 112 AS tx, (uy - q / d * mx - p / d * my) * {SIDE} / 112 AS ty FROM s),
  g AS (SELECT *, (a * (x - tx) + b * (y - ty)) / (a * a + b * b) AS sx, (a * (y - ty) - b * (x - tx)) / (a * a + b * b) AS sy FROM t, range({SIDE}) AS u(y), range({SIDE}) AS v(x)),
  f AS (SELECT *, floor(sx) AS fx, floor(sy) AS fy FROM g)
SELECT vec_id, CAST(y * {SIDE} + x AS BIGINT) AS place, round((1 - (sy - fy)) * ((1 - (sx - fx)) * {_pixel("fy", "fx")} + (sx - fx) * {_pixel("fy", "(fx + 1)")})
  + (sy - fy) * ((1 - (sx - fx)) * {_pixel("(fy + 1)", "fx")} + (sx - fx) * {_pixel("(fy + 1)", "(fx + 1)")}), 4) + 0.0 AS value FROM f""")
def pixel_warp(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors as grey images of 8 x 8 pixels, warped so that five landmarks come to lie on the template, 16 x 16."""
    v = F.col("v")
    rows = table(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("v"))
    marks = F.array(*[F.array(v[i] * 12 + 3.5, v[i + 5] * 12 + 3.5) for i in range(5)])
    fitted = rows.select("vec_id", F.transform("v", lambda x: x * 100).alias("image"), G.similarity_transform(marks).alias("t"))
    small = F.struct(*[(F.col(f"t.{c}") * SIDE / 112).alias(c) for c in ("a", "b", "tx", "ty")])
    warped = fitted.select("vec_id", "image", small.alias("t")).select("vec_id", P.warped(F.col("image"), 8, 8, F.col("t"), SIDE, SIDE, 1).alias("w"))
    return warped.select("vec_id", F.posexplode("w").alias("place", "value")).select("vec_id", F.col("place").cast("long").alias("place"), (F.round("value", 4) + 0.0).alias("value"))
