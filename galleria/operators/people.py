"""Listings, details, history and counts over persons, photos and recognition results.

Tables: persons (person_id, identity_id, name, is_active, created_at), identities (identity_id, display_name), photos
(photo_id, person_id, status, created_at), results (request_id, face_index, status, person_id), requests (request_id,
created_at).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F


def photo_counts(persons: DataFrame, identities: DataFrame, photos: DataFrame, search: str | None = None, is_active: bool | None = None) -> DataFrame:
    """Active persons that have an active photo: their identity, number of photos and primary photo (the least id as text).

    search is a case-insensitive pattern found anywhere in the names; its % and _ are wildcards. is_active adds a
    condition to the one that persons are active, so False finds nobody.
    """
    people = persons.where(F.col("is_active").eqNullSafe(True))
    if is_active is not None:
        people = people.where(F.col("is_active").eqNullSafe(is_active))
    joined = people.join(identities, "identity_id")
    if search is not None:
        joined = joined.where(F.col("name").ilike(f"%{search}%") | F.col("display_name").ilike(f"%{search}%"))
    active = photos.where(F.col("status") == "active").select("person_id", "photo_id")
    # A person without an active photo is left out, so the left join of a listing with "count > 0" is an inner one.
    counts = active.groupBy("person_id").agg(F.countDistinct("photo_id").alias("photo_count"), F.min(F.col("photo_id").cast("string")).alias("primary_photo_id"))
    return joined.join(counts, "person_id")


def list_persons(persons: DataFrame, identities: DataFrame, photos: DataFrame, search: str | None = None, is_active: bool | None = None, limit: int = 20, offset: int = 0) -> DataFrame:
    """A page of `photo_counts`, the newest first, ties by person_id."""
    if not 1 <= limit <= 100 or offset < 0:
        raise ValueError("limit must be between 1 and 100 and offset not negative")
    return photo_counts(persons, identities, photos, search, is_active).orderBy(F.desc("created_at"), "person_id").offset(offset).limit(limit)


def person_photos(persons: DataFrame, photos: DataFrame) -> DataFrame:
    """Active persons with their primary active photo (the least id) and all photos that aren't deleted, newest first."""
    shown = photos.where(F.col("status") != "deleted")
    per = shown.groupBy("person_id").agg(
        F.array_sort(F.collect_list(F.struct((-F.unix_micros("created_at")).alias("age"), "photo_id", "status"))).alias("photos"),
        F.min(F.when(F.col("status") == "active", F.col("photo_id"))).alias("primary_photo_id"),
    )
    return persons.where(F.col("is_active").eqNullSafe(True)).join(per, "person_id", "left")


def person_history(results: DataFrame, requests: DataFrame) -> DataFrame:
    """Known results of each person with the time of the request."""
    known = results.where((F.col("status") == "known") & F.col("person_id").isNotNull())
    return known.join(requests, "request_id")


def process_detail(results: DataFrame, persons: DataFrame) -> DataFrame:
    """Faces of each request in order, with identity and name for the known ones, and how many are known."""
    named = results.join(persons.select("person_id", "identity_id", "name"), "person_id", "left")
    known = F.col("status") == "known"
    face = F.struct("face_index", "status", F.when(known, F.col("identity_id")).alias("identity_id"), F.when(known, F.col("name")).alias("name"))
    return named.groupBy("request_id").agg(F.sort_array(F.collect_list(face)).alias("faces"), F.count_if(known).alias("n_known"), F.count_if(~known).alias("n_unknown"))


def enrolment_stats(persons: DataFrame, identities: DataFrame, photos: DataFrame, requests: DataFrame) -> DataFrame:
    """One row: active persons, identities that have one, active photos, requests."""
    active = persons.where("is_active")
    used = identities.join(active.select("identity_id"), "identity_id", "left_semi")
    counts = [active.agg(F.count("*").alias("persons")), used.agg(F.count("*").alias("identities")), photos.where("status = 'active'").agg(F.count("*").alias("photos")), requests.agg(F.count("*").alias("requests"))]
    # Each side has one row, so the joins without a condition make one row.
    row = counts[0]
    for c in counts[1:]:
        row = row.join(F.broadcast(c))
    return row
