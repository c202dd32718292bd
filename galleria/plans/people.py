"""Listings, details, history and counts of persons."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F

from galleria.functions.display import summary
from galleria.operators import layout as L, people as P, text_index as X
from galleria.plans import tables as T
from galleria.plans.registry import query, table
from galleria.streaming.run import folder

COUNTED = T.SQL + """, listed AS (
  SELECT p.person_id, p.name, i.display_name, p.created_at, count(DISTINCT f.photo_id) AS photo_count, min(CAST(f.photo_id AS VARCHAR)) AS primary_photo_id
  FROM persons p JOIN identities i USING (identity_id) LEFT JOIN photos f ON f.person_id = p.person_id AND f.status = 'active'
  WHERE p.is_active IS TRUE {more} GROUP BY 1, 2, 3, 4 HAVING count(DISTINCT f.photo_id) > 0
) """
COLUMNS = ["person_id", "name", "display_name", "created_at", "photo_count", "primary_photo_id"]


def three(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    return T.persons(spark, d), T.identities(spark, d), T.photos(spark, d)


@query(COUNTED.format(more="") + "SELECT * FROM listed")
def list_faces_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.photo_counts(*three(spark, sf_dir)).select(*COLUMNS)


@query(COUNTED.format(more="") + "SELECT * FROM listed")
def list_faces_bucketed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The listing over tables in buckets of persons: photos are counted and joined where they lie."""
    persons, identities, photos = three(spark, sf_dir)
    kept = [L.store_by_person(df, f"{folder(spark)}/{name}", f"{name}_{uuid.uuid4().hex}") for df, name in ((persons, "persons"), (photos, "photos"))]
    return P.photo_counts(kept[0], F.broadcast(identities), kept[1]).select(*COLUMNS)


@query(COUNTED.format(more="") + "SELECT * FROM listed ORDER BY created_at DESC, person_id LIMIT 20 OFFSET 40")
def list_faces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The third page."""
    return P.list_persons(*three(spark, sf_dir), limit=20, offset=40).select(*COLUMNS)


@query(COUNTED.format(more="AND (p.name ILIKE '%9_1%' OR i.display_name ILIKE '%9_1%')") + "SELECT * FROM listed ORDER BY created_at DESC, person_id LIMIT 100")
def list_faces_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.list_persons(*three(spark, sf_dir), search="9_1", limit=100).select(*COLUMNS)


@query(COUNTED.format(more="AND (p.name ILIKE '%009_1%' OR i.display_name ILIKE '%009_1%')") + "SELECT * FROM listed")
def list_faces_indexed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The persons whose name or identity an index of trigrams finds."""
    persons, identities, photos = three(spark, sf_dir)
    names = persons.join(identities, "identity_id").select(F.col("person_id").alias("id"), F.explode(F.array("name", "display_name")).alias("text"))
    path = folder(spark)
    X.build(names, path)
    found = X.search(spark, path, "%009_1%").select(F.col("id").alias("person_id")).distinct()
    return P.photo_counts(persons.join(found, "person_id", "left_semi"), identities, photos).select(*COLUMNS)


@query(COUNTED.format(more="AND p.is_active IS FALSE") + "SELECT * FROM listed ORDER BY created_at DESC, person_id LIMIT 20")
def list_faces_inactive(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Always empty: inactive persons are never listed."""
    return P.list_persons(*three(spark, sf_dir), is_active=False).select(*COLUMNS)


@query(COUNTED.format(more="") + "SELECT count(*) AS total FROM listed")
def list_faces_total(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.photo_counts(*three(spark, sf_dir)).agg(F.countDistinct("person_id").alias("total"))


@query(T.SQL + """SELECT p.person_id, coalesce(count(f.photo_id), 0) AS n_photos, min(CASE WHEN f.status = 'active' THEN f.photo_id END) AS primary_photo_id,
  string_agg(CAST(f.photo_id AS VARCHAR), ',' ORDER BY f.created_at DESC, f.photo_id) AS photos
  FROM persons p LEFT JOIN photos f ON f.person_id = p.person_id AND f.status <> 'deleted' WHERE p.is_active GROUP BY p.person_id""")
def face_detail_photos(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = P.person_photos(T.persons(spark, sf_dir), T.photos(spark, sf_dir))
    listed = F.array_join(F.transform("photos", lambda p: p["photo_id"].cast("string")), ",")
    return rows.select("person_id", F.when(F.col("photos").isNull(), 0).otherwise(F.size("photos")).cast("long").alias("n_photos"), "primary_photo_id", listed.alias("photos"))


@query(T.SQL + "SELECT r.person_id, r.request_id, r.face_index, q.created_at FROM results r JOIN requests q USING (request_id) WHERE r.status = 'known'")
def face_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.person_history(T.results(spark, sf_dir), T.requests(spark, sf_dir)).select("person_id", "request_id", "face_index", "created_at")


@query(T.SQL + """SELECT request_id, CAST(count_if(status = 'known') AS BIGINT) AS n_known, CAST(count_if(status <> 'known') AS BIGINT) AS n_unknown,
  string_agg(face_index || ':' || status || ':' || CASE WHEN status = 'known' THEN coalesce(name, '-') ELSE '-' END, ',' ORDER BY face_index) AS faces
  FROM results LEFT JOIN persons USING (person_id) GROUP BY request_id""")
def process_detail(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = P.process_detail(T.results(spark, sf_dir), T.persons(spark, sf_dir))
    told = F.transform("faces", lambda f: F.concat_ws(":", f["face_index"].cast("string"), f["status"], F.coalesce(f["name"], F.lit("-"))))
    return rows.select("request_id", "n_known", "n_unknown", F.array_join(told, ",").alias("faces"))


@query(T.SQL + """SELECT (SELECT count(*) FROM persons WHERE is_active) AS persons, (SELECT count(*) FROM identities i WHERE EXISTS (SELECT 1 FROM persons p WHERE p.identity_id = i.identity_id AND p.is_active)) AS identities,
  (SELECT count(*) FROM photos WHERE status = 'active') AS photos, (SELECT count(*) FROM requests) AS requests""")
def enrollment_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.enrolment_stats(T.persons(spark, sf_dir), T.identities(spark, sf_dir), T.photos(spark, sf_dir), T.requests(spark, sf_dir))


@query("""SELECT conv_id AS request_id, CAST(count_if(role = 'assistant') AS INTEGER) AS known, CAST(count_if(role <> 'assistant') AS INTEGER) AS unknown, string_agg(array_to_string([turn + k FOR k IN range(0, least(3, turn % 6))], '+'), ',' ORDER BY turn) AS shown FROM conversations GROUP BY conv_id""")
def response_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Known and unknown faces of each request, and the first three candidates of each face."""
    turn = F.col("turn")
    candidates = F.when(turn % 6 == 0, F.array().cast("array<bigint>")).otherwise(F.transform(F.sequence(F.lit(0), F.greatest(turn % 6, F.lit(1)).cast("int") - 1), lambda k: turn + k))
    face = F.struct("turn", F.when(F.col("role") == "assistant", "known").otherwise("unknown").alias("status"), candidates.alias("candidates"))
    rows = table(spark, sf_dir, "conversations").groupBy(F.col("conv_id").alias("request_id")).agg(F.sort_array(F.collect_list(face)).alias("faces"))
    told = F.array_join(F.transform("s.shown", lambda c: F.array_join(c.cast("array<string>"), "+")), ",")
    return rows.select("request_id", summary(F.col("faces")).alias("s")).select("request_id", "s.known", "s.unknown", told.alias("shown"))
