"""How scores, progress and pages are shown."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

DASH = "-"
#: Labels of the states of recognition results and jobs.
STATUS_LABELS = {"known": "Known", "unknown": "Unknown", "pending": "Pending", "queued": "Queued", "running": "Running", "completed": "Completed", "completed_with_warnings": "Completed with warnings", "failed": "Failed", "cancel_requested": "Cancel requested", "cancelling": "Cancelling", "cancelled": "Cancelled"}


def fixed(x: Column, places: int) -> Column:
    """Decimal text with so many places, rounded half away from zero."""
    return F.round(x.cast("decimal(20,10)"), places).cast(f"decimal(20,{places})").cast("string")


def clamp(x: Column, low: float = 0.0, high: float = 1.0) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), x))


def similarity_text(score: Column) -> Column:
    return F.when(score.isNull(), DASH).otherwise(fixed(clamp(score), 2))


def similarity_percent(score: Column) -> Column:
    return F.when(score.isNull(), DASH).otherwise(F.concat(fixed(clamp(score) * 100, 1), F.lit("%")))


def margin_text(score: Column, threshold: Column) -> Column:
    """How far a score is above the threshold, with its sign."""
    d = score - threshold
    return F.when(d.isNull(), DASH).otherwise(F.concat(F.when(d >= 0, "+").otherwise(""), fixed(d, 2)))


def status_label(status: Column) -> Column:
    labels = F.create_map(*[F.lit(x) for pair in STATUS_LABELS.items() for x in pair])
    return F.coalesce(labels[status], status)


def progress_percent(processed: Column, requested: Column) -> Column:
    """0 to 100; nothing requested is no progress."""
    return F.least(F.lit(100.0), F.coalesce(F.round(F.try_divide(processed.cast("double"), requested.cast("double")) * 100), F.lit(0.0))).cast("long")


def eta_seconds(remaining: Column, rate: Column) -> Column:
    """Seconds left; null where nothing moves."""
    return F.try_divide(F.greatest(remaining, F.lit(0)).cast("double"), rate.cast("double"))


def page_numbers(offset: Column, limit: Column, total: Column) -> Column:
    """page, pages, and the first and last row shown."""
    return F.struct(
        (F.floor(offset / limit) + 1).alias("page"),
        F.ceil(total / limit).alias("pages"),
        F.least(offset + 1, total).alias("first_row"),
        F.least(offset + limit, total).alias("last_row"),
    )


def iso_utc(ts: Column) -> Column:
    """A timestamp as ISO text in UTC, with microseconds only where there are any."""
    utc = F.convert_timezone(F.current_timezone(), F.lit("UTC"), ts.cast("timestamp_ntz"))
    micros = F.unix_micros(ts) % 1_000_000
    part = F.when(micros == 0, "").otherwise(F.concat(F.lit("."), F.lpad(micros.cast("string"), 6, "0")))
    return F.concat(F.date_format(utc, "yyyy-MM-dd'T'HH:mm:ss"), part, F.lit("+00:00"))


def summary(faces: Column) -> Column:
    """How many faces of a response are known and unknown, and the first three candidates of each. faces: status, candidates."""
    known = F.size(F.filter(faces, lambda f: f["status"] == "known"))
    return F.struct(known.alias("known"), (F.size(faces) - known).alias("unknown"), F.transform(faces, lambda f: F.slice(f["candidates"], 1, 3)).alias("shown"))
