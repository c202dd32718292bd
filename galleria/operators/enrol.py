"""Enrolment of faces over plain tables: identities, persons, photos, samples and vectors.

A batch of items is applied as if its items came one by one in the order of their index; the tables that come out are the
next state of those that went in. Ids are derived from what they name, so a batch that comes twice changes nothing.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, Window, functions as F

from galleria.functions.geometry import area
from galleria.functions.identity import derived_id, full_name, hmac_sha256, mask_tail, split_name
from galleria.functions.vectors import faults
from galleria.operators.ingest import insert_ignore, validated

#: Gives the same rows back, from a written table perhaps; what is decided for a batch is then worked out once.
Stage = Callable[[DataFrame], DataFrame]

DUPLICATE, NO_FACE, NO_PERSON, KNOWN_PERSON = "this exact photo is already enrolled for this person", "no face detected", "person not found", "person is already enrolled"


@dataclass(frozen=True)
class Gallery:
    """identities: identity_id, lookup, display_name. persons: person_id, identity_id, lookup, masked, first_name, last_name,
    details. photos: photo_id, person_id, content, status, deleted_at. samples: sample_id, person_id, photo_id, box,
    landmarks, score, status. vectors: sample_id, photo_id, person_id, active, model, embedding."""

    identities: DataFrame
    persons: DataFrame
    photos: DataFrame
    samples: DataFrame
    vectors: DataFrame


def largest_faces(faces: DataFrame) -> DataFrame:
    """The face with the largest box of each index, the first ordinal on ties: index, face (a struct).

    faces: index, ordinal, box, landmarks, embedding, score.
    """
    face = F.struct("box", "landmarks", "embedding", "score")
    return faces.groupBy("index").agg(F.max_by(face, F.struct(area(F.col("box")), -F.col("ordinal"))).alias("face"))


def _fresh(rows: DataFrame, photos: DataFrame, dim: int | None, stage: Stage) -> tuple[DataFrame, DataFrame]:
    """Rows with a face whose photo its person doesn't have yet, with photo_id, and the rejects (index, message).

    rows: index, person_id, content, face. Of equal photos of a person in the batch the first index counts. With dim, faces
    whose vector can't be stored are rejected.
    """
    wrong = F.array_join(faults(F.col("face.embedding"), dim), ", ") if dim else F.lit("")
    unfit = F.col("face").isNull() | (wrong != "")
    seen = photos.select("person_id", "content").distinct().withColumn("seen", F.lit(True))
    place = F.row_number().over(Window.partitionBy("person_id", "content").orderBy(unfit, "index"))
    marked = rows.join(seen, ["person_id", "content"], "left").withColumn("place", place)
    message = F.when(F.col("face").isNull(), NO_FACE).when(unfit, F.concat(F.lit("vector: "), wrong)).when(F.col("seen") | (F.col("place") > 1), DUPLICATE)
    photo_id = derived_id("photo", F.concat_ws(":", "person_id", "content"))
    marked = stage(marked.withColumn("message", message).drop("seen", "place").withColumn("photo_id", photo_id))
    return marked.where("message IS NULL").drop("message"), marked.where("message IS NOT NULL").select("index", "message")


def _with_faces(gallery: Gallery, rows: DataFrame, model: str) -> tuple[Gallery, DataFrame]:
    """The gallery with photo, sample and vector of each row (person_id, photo_id, content, face), and rows with sample_id."""
    rows = rows.withColumn("sample_id", derived_id("sample", F.concat_ws(":", "photo_id", F.lit(model))))
    photos = rows.select("photo_id", "person_id", "content", F.lit("active").alias("status"), F.lit(None).cast("timestamp").alias("deleted_at"))
    samples = rows.select("sample_id", "person_id", "photo_id", "face.box", "face.landmarks", "face.score", F.lit("active").alias("status"))
    vectors = rows.select("sample_id", "photo_id", "person_id", F.lit(True).alias("active"), F.lit(model).alias("model"), "face.embedding")
    return replace(gallery, photos=gallery.photos.unionByName(photos), samples=gallery.samples.unionByName(samples), vectors=gallery.vectors.unionByName(vectors)), rows


def enrol(gallery: Gallery, items: DataFrame, faces: DataFrame, key: str, model: str = "default", known_persons: str = "update", dim: int | None = None, stage: Stage = lambda rows: rows) -> tuple[Gallery, DataFrame, DataFrame]:
    """Enrol persons with a photo each: the next gallery, records and errors (index, message).

    items: index, name, national_id, length (bytes of the photo), content (its hash), details (null: not given). The
    largest face of a photo counts. A new national id makes an identity and a person. A known one gets the new names, and
    the new details where they are given; with known_persons="reject" it is an error instead, also within the batch.
    With dim, an item whose face has no vector of that dimension, a zero one or one with NaN or infinite numbers is an error.
    Rejected items change nothing. stage writes what is decided for the batch, so that the tables that come out don't work it
    out once each. Records: index, identity_id, person_id, photo_id, sample_id, name.
    """
    if known_persons not in ("update", "reject"):
        raise ValueError("known_persons must be update or reject")
    good, errors = validated(items)
    lookup = hmac_sha256(F.col("national_id"), key)
    rows = good.join(largest_faces(faces), "index", "left").withColumns({"lookup": lookup, "masked": mask_tail(F.col("national_id")), "names": split_name(F.col("name"))})
    known = gallery.persons.select("lookup", F.col("person_id").alias("known_id"))
    rows = rows.join(known, "lookup", "left").withColumns({"person_id": F.coalesce("known_id", derived_id("person", F.col("lookup"))), "identity_id": derived_id("identity", F.col("lookup"))})
    if known_persons == "reject":
        first = F.row_number().over(Window.partitionBy("lookup").orderBy(F.col("face").isNull(), "index")) == 1
        rows = rows.withColumn("twice", F.col("face").isNotNull() & (F.col("known_id").isNotNull() | ~first))
        errors = errors.unionByName(rows.where("twice").select("index", F.lit(KNOWN_PERSON).alias("message")))
        rows = rows.where("NOT twice").drop("twice")
    fresh, more = _fresh(rows, gallery.photos, dim, stage)
    after, fresh = _with_faces(gallery, fresh, model)
    identities = fresh.select("identity_id", "lookup", full_name(F.col("names.first_name"), F.col("names.last_name")).alias("display_name"), "index")
    # Of several items of a person the last one gives the names, and the last one that has details gives these.
    given = F.col("details").isNotNull()
    new = fresh.groupBy("person_id", "identity_id", "lookup", "masked").agg(F.max_by("names", "index").alias("names"), F.max_by(F.when(given, F.col("details")), F.when(given, F.col("index"))).alias("new_details"))
    # A batch is small beside the persons: Spark can send it to them where they lie, as it couldn't in an outer join of both.
    hit = F.col("names").isNotNull()
    renamed = gallery.persons.join(new.select("person_id", F.col("identity_id").alias("new_identity"), "names", "new_details"), "person_id", "left").select(
        "person_id",
        F.when(hit, F.col("new_identity")).otherwise(F.col("identity_id")).alias("identity_id"),
        "lookup",
        "masked",
        F.when(hit, F.col("names.first_name")).otherwise(F.col("first_name")).alias("first_name"),
        F.when(hit, F.col("names.last_name")).otherwise(F.col("last_name")).alias("last_name"),
        F.coalesce("new_details", "details").alias("details"),
    )
    added = new.join(gallery.persons.select("person_id"), "person_id", "left_anti").select("person_id", "identity_id", "lookup", "masked", "names.first_name", "names.last_name", F.col("new_details").alias("details"))
    persons = renamed.unionByName(added)
    after = replace(after, identities=insert_ignore(gallery.identities, identities, ["lookup"], [F.col("index")]), persons=persons)
    records = fresh.select("index", "identity_id", "person_id", "photo_id", "sample_id", full_name(F.col("names.first_name"), F.col("names.last_name")).alias("name"))
    return after, records, errors.unionByName(more)


def add_photos(gallery: Gallery, items: DataFrame, faces: DataFrame, model: str = "default", dim: int | None = None, stage: Stage = lambda rows: rows) -> tuple[Gallery, DataFrame, DataFrame]:
    """Add photos to persons that are there, active or not: the next gallery, records and errors (index, message).

    items: index, identity_id, length, content. dim and stage as in `enrol`. Records: index, identity_id, person_id, photo_id, sample_id.
    """
    rows = items.join(gallery.persons.select("identity_id", "person_id"), "identity_id", "left").join(largest_faces(faces), "index", "left")
    message = F.when(F.coalesce("length", F.lit(0)) == 0, "empty image").when(F.col("person_id").isNull(), NO_PERSON)
    marked = rows.withColumn("message", message)
    fresh, errors = _fresh(marked.where("message IS NULL").drop("message"), gallery.photos, dim, stage)
    after, fresh = _with_faces(gallery, fresh, model)
    return after, fresh.select("index", "identity_id", "person_id", "photo_id", "sample_id"), errors.unionByName(marked.where("message IS NOT NULL").select("index", "message"))


def delete_photos(gallery: Gallery, asked: DataFrame, as_of: Column) -> tuple[Gallery, DataFrame]:
    """The gallery with single photos marked as deleted, their samples too and their vectors inactive; and what wasn't found.

    asked: identity_id, photo_id. A photo is found under its own person only; deleting it again renews its time.
    """
    pairs = asked.select("identity_id", "photo_id").distinct()
    owners = gallery.photos.select("photo_id", "person_id").join(gallery.persons.select("person_id", "identity_id"), "person_id")
    hit = pairs.join(owners, ["identity_id", "photo_id"], "left_semi").select("photo_id").distinct().withColumn("__hit", F.lit(True))
    gone = F.col("__hit").isNotNull()
    mark = lambda df, **new: df.join(hit, "photo_id", "left").withColumns({c: F.when(gone, v).otherwise(F.col(c)) for c, v in new.items()}).select(*df.columns)
    after = replace(
        gallery,
        photos=mark(gallery.photos, status=F.lit("deleted"), deleted_at=as_of),
        samples=mark(gallery.samples, status=F.lit("deleted")),
        vectors=mark(gallery.vectors, active=F.lit(False)),
    )
    return after, pairs.join(owners, ["identity_id", "photo_id"], "left_anti")


def live_samples(gallery: Gallery, persons: DataFrame | None = None) -> DataFrame:
    """Samples that aren't deleted with the state of their photo, of all persons or of those asked for (person_id)."""
    kept = gallery.samples.where(F.col("status") != "deleted")
    kept = kept if persons is None else kept.join(persons.select("person_id").distinct(), "person_id", "left_semi")
    return kept.join(gallery.photos.select("photo_id", F.col("status").alias("photo_status")), "photo_id")


def put_objects(objects: DataFrame, incoming: DataFrame) -> DataFrame:
    """Stored objects (object_key, content) after others were put; a known key is overwritten, of equal new keys the largest
    content counts."""
    new = incoming.groupBy("object_key").agg(F.max("content").alias("content"))
    return objects.join(new, "object_key", "left_anti").select("object_key", "content").unionByName(new)


def delete_objects(objects: DataFrame, keys: DataFrame) -> DataFrame:
    """Stored objects without those of some keys; unknown keys do nothing."""
    return objects.join(keys.select("object_key").distinct(), "object_key", "left_anti")


#: Tables in the order in which they can be emptied: children first.
RESET_ORDER = ("recognition_result", "recognition_request", "face_sample", "person_photo", "person", "face_identity", "process_event", "process_record")


def reset(tables: dict[str, DataFrame]) -> tuple[dict[str, DataFrame], DataFrame]:
    """Empty tables in the order of RESET_ORDER, and how many rows each had (name, place, n)."""
    names = [n for n in RESET_ORDER if n in tables] + sorted(n for n in tables if n not in RESET_ORDER)
    counts = None
    for i, n in enumerate(names):
        one = tables[n].agg(F.count("*").alias("n")).select(F.lit(n).alias("name"), F.lit(i).alias("place"), "n")
        counts = one if counts is None else counts.unionByName(one)
    if counts is None:
        raise ValueError("no tables to reset")
    return {n: tables[n].limit(0) for n in names}, counts
