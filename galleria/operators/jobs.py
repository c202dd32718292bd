"""Bulk jobs: planning, roll-up of shard counters, outcomes, resume and cancel."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from galleria.functions.identity import derived_id

SOFT_LIMIT = 0.03
TERMINAL = ("completed", "completed_with_warnings", "failed", "cancelled")
#: What a request to cancel makes of each state; other states stay.
CANCELS = {"pending": "cancel_requested", "queued": "cancel_requested", "running": "cancel_requested", "cancel_requested": "cancelling"}
#: Allowed next states of a process.
NEXT = {
    "pending": ("queued", "running", "cancel_requested", "failed"),
    "queued": ("running", "cancel_requested", "failed"),
    "running": ("completed", "completed_with_warnings", "failed", "cancel_requested"),
    "cancel_requested": ("cancelling", "cancelled"),
    "cancelling": ("cancelled", "failed"),
}


def budget(requested: Column, discovered: Column, target: Column, active: Column) -> Column:
    """Photos that a job may take; null (an error) if there are none."""
    n = F.least(F.coalesce(requested, discovered), F.greatest(F.lit(0), target - active), discovered)
    return F.when(n > 0, n)


def plan_jobs(jobs: DataFrame, workers: int) -> DataFrame:
    """A row for each shard: job_id, shard_index, max_photos (the budget over the workers, rounded up) and process_id.

    jobs: job_id, requested, discovered, target, active. Jobs without a budget have no shards.
    """
    n = budget(F.col("requested"), F.col("discovered"), F.col("target"), F.col("active"))
    rows = jobs.withColumn("budget", n).where("budget IS NOT NULL")
    shards = rows.select("job_id", F.ceil(F.col("budget") / workers).alias("max_photos"), F.explode(F.sequence(F.lit(0), F.lit(workers - 1))).alias("shard_index"))
    return shards.withColumn("process_id", derived_id("process", F.concat_ws(":", F.lit("shard"), F.col("job_id").cast("string"), F.col("shard_index").cast("string"))))


def outcome(fatal: Column, failed: Column, no_face: Column, decode: Column, discovered: Column) -> Column:
    """How a worker's job ended: hard failures fail it, soft ones too above SOFT_LIMIT."""
    soft = no_face + decode
    return F.when(fatal | (failed > 0) | (soft / F.greatest(discovered, F.lit(1)) > SOFT_LIMIT), "failed").when(soft > 0, "completed_with_warnings").otherwise("completed")


def parent_status(cancelled: Column, running: Column, failed: Column) -> Column:
    return F.when((cancelled > 0) & (running == 0) & (failed == 0), "cancelled").when(failed > 0, "failed").otherwise("completed")


def rate(total: Column, seconds: Column) -> Column:
    """Per second, two places; 0 where no time has passed."""
    return F.coalesce(F.round(F.when(seconds > 0, F.try_divide(total.cast("double"), seconds)), 2), F.lit(0.0))


def elapsed(started: Column, completed: Column, as_of: Column) -> Column:
    """Seconds from the start to the end, or to as_of while it runs."""
    return F.greatest((F.unix_micros(F.coalesce(completed, as_of)) - F.unix_micros(started)) / 1e6, F.lit(0.0))


def aggregate_jobs(shards: DataFrame) -> DataFrame:
    """Counters of each job over its shards, states counted, and rates.

    shards: job_id, status (null: not started, counts as queued), enrolled, no_face, decode, failed, discovered, fatal,
    started, seconds.
    """
    status = F.coalesce("status", F.lit("queued"))
    sums = [F.coalesce(F.sum(c), F.lit(0)).cast("long").alias(c) for c in ("enrolled", "no_face", "decode", "failed", "discovered")]
    rows = shards.groupBy("job_id").agg(
        *sums,
        F.coalesce(F.bool_or("fatal"), F.lit(False)).alias("fatal"),
        F.count("*").alias("n_shards"),
        F.count_if(status == "failed").alias("n_failed"),
        F.count_if(status == "cancelled").alias("n_cancelled"),
        F.count_if(status.isin("running", "queued", "pending")).alias("n_running"),
        F.max("seconds").alias("seconds"),
    )
    return rows.withColumns(
        {
            "n_completed": F.col("n_shards") - F.col("n_failed") - F.col("n_cancelled") - F.col("n_running"),
            "status": parent_status(F.col("n_cancelled"), F.col("n_running"), F.col("n_failed")),
            "outcome": outcome(F.col("fatal"), F.col("failed"), F.col("no_face"), F.col("decode"), F.col("discovered")),
            "rate": rate(F.col("enrolled"), F.col("seconds")),
        }
    )


def with_shards(parents: DataFrame, records: DataFrame) -> DataFrame:
    """Shards of each parent (an array column) with the record of their derived process; missing ones are queued."""
    rows = parents.select("job_id", F.explode("shards").alias("s")).select("job_id", "s.*")
    keyed = rows.withColumn("process_id", derived_id("process", F.concat_ws(":", F.lit("shard"), F.col("job_id").cast("string"), F.col("shard_index").cast("string"))))
    return keyed.join(records, "process_id", "left").withColumn("status", F.coalesce("status", F.lit("queued")))


def job_progress(parents: DataFrame, records: DataFrame) -> DataFrame:
    """Counters, states and rates of parents over the records of their shards, and the seconds they took.

    parents: job_id, shards (array of structs with shard_index), started, completed, as_of (timestamps). records: process_id
    and the columns of `aggregate_jobs`. A shard without a record is queued.
    """
    rolled = aggregate_jobs(with_shards(parents, records))
    took = elapsed(F.col("started"), F.col("completed"), F.col("as_of"))
    return rolled.drop("seconds", "rate").join(parents.select("job_id", took.alias("seconds")), "job_id").withColumn("rate", rate(F.col("enrolled"), F.col("seconds")))


def of_type(records: DataFrame, kind: str) -> DataFrame:
    """The process records of one type; a job asked for under another type isn't found."""
    return records.where(F.col("process_type") == kind)


def append_events(log: DataFrame, changes: DataFrame, order: list[str]) -> DataFrame:
    """The events that state changes add to a log: process_id, sequence, event_type, before, after, message.

    log: process_id, sequence, after. changes: process_id, event_type, after, message and the columns of the order. The
    sequence of each process goes on without gaps, and before is the state that the event before it left (null for the
    first one).
    """
    last = log.groupBy("process_id").agg(F.max("sequence").alias("done"), F.max_by("after", "sequence").alias("state"))
    w = Window.partitionBy("process_id").orderBy(*order)
    joined = changes.join(last, "process_id", "left")
    n = F.row_number().over(w)
    before = F.when(n == 1, F.col("state")).otherwise(F.lag("after").over(w))
    return joined.select("process_id", (F.coalesce("done", F.lit(0)) + n).cast("long").alias("sequence"), "event_type", before.alias("before"), "after", "message")


def to_run(requests: DataFrame, records: DataFrame) -> DataFrame:
    """What becomes of job requests: idempotency_key, process_id, run (whether it has to run) and the stored result.

    requests: idempotency_key, repeats count once. records: process_id, status, result. The process id is derived from the
    key, so a request that comes again finds its record: one that has completed or failed isn't run again.
    """
    keyed = requests.select("idempotency_key").distinct().withColumn("process_id", derived_id("process", F.concat(F.lit("job:"), "idempotency_key")))
    ended = F.coalesce(F.col("status").isin("completed", "completed_with_warnings", "failed"), F.lit(False))
    return keyed.join(records.select("process_id", "status", "result"), "process_id", "left").select("idempotency_key", "process_id", (~ended).alias("run"), F.when(ended, F.col("result")).alias("result"))


def split_by(index: Column, n: int, total: Column | None = None) -> Column:
    """The part (0 to n - 1) of an item by its index: in turn, or in neighbouring runs of equal size where the total is given."""
    if n <= 0:
        raise ValueError("the number of parts must be positive")
    return (index % n).cast("int") if total is None else F.floor(index * n / total).cast("int")


def request_states(requests: DataFrame, faces: DataFrame) -> DataFrame:
    """request_id, status and face_count: failed where the extraction failed (then no faces count), completed otherwise.

    requests: request_id, extracted (boolean; null counts as failed). faces: request_id, a row for each face.
    """
    counts = faces.groupBy("request_id").agg(F.count("*").alias("n"))
    ok = F.coalesce("extracted", F.lit(False))
    return requests.join(counts, "request_id", "left").select("request_id", F.when(ok, "completed").otherwise("failed").alias("status"), F.when(ok, F.coalesce("n", F.lit(0))).otherwise(F.lit(0)).cast("long").alias("face_count"))


def replace_shard(shards: Column, index: Column, status: Column) -> Column:
    """The array of shards with the status of one replaced."""
    return F.transform(shards, lambda s: F.when(s["shard_index"] == index, s.withField("status", status)).otherwise(s))


def resumed(shards: Column, last_key: Column) -> Column:
    """Shards of a job that starts again: ended ones are queued and go on after the last identity they did."""
    return F.transform(shards, lambda s: F.when(s["status"].isin(*TERMINAL), s.withField("status", F.lit("queued")).withField("after_key", last_key)).otherwise(s.withField("after_key", F.lit(None).cast("string"))))


def cancelled(status: Column) -> Column:
    """State after one more request to cancel."""
    known = F.create_map(*[F.lit(x) for pair in CANCELS.items() for x in pair])
    return F.coalesce(known[status], status)


def valid_transition(before: Column, after: Column) -> Column:
    """Whether a process may go from one state to the other."""
    allowed = F.create_map(*[x for k, v in NEXT.items() for x in (F.lit(k), F.array(*map(F.lit, v)))])
    return F.coalesce(F.array_contains(allowed[before], after), F.lit(False))


def metadata_matches(existing: Column, wanted: dict[str, str]) -> Column:
    """Whether a map has all wanted keys with equal values, so that what it describes can be used again."""
    match = F.lit(True)
    for key, value in wanted.items():
        match = match & F.coalesce(existing[key] == value, F.lit(False))
    return match


def model_kinds(outputs: DataFrame, dim: int = 512) -> DataFrame:
    """detector, recognizer or unknown for each model of outputs (model, input_rank, count, channels).

    A detector has some anchor count with outputs of 1, 4 and 10 channels; a recognizer takes 4-d input and its output
    has dim channels.
    """
    counts = outputs.groupBy("model", "count").agg(F.array_sort(F.collect_set("channels")).alias("c"), F.max(F.when((F.col("input_rank") == 4) & (F.col("channels") == dim), 1).otherwise(0)).alias("r"))
    detector = F.bool_or(F.size(F.array_intersect("c", F.array(*map(F.lit, (1, 4, 10))))) == 3)
    return counts.groupBy("model").agg(F.when(detector, "detector").when(F.max("r") == 1, "recognizer").otherwise("unknown").alias("kind"))
