"""Streaming extensions over `events`, run to the end of the table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from galleria.operators.jobs import NEXT
from galleria.plans.registry import query
from galleria.streaming import process_log as P, run
from galleria.streaming.keyed_table import KeyedTable, merge_batch

STATES = """CASE event_type WHEN 'signup' THEN 'queued' WHEN 'view' THEN 'running' WHEN 'click' THEN 'cancel_requested' WHEN 'error' THEN 'failed' ELSE 'completed' END"""


@query("SELECT CAST(epoch(time_bucket(INTERVAL '1 hour', ts)) AS BIGINT) AS start_s, event_type, count(*) AS n, round(avg(value), 6) AS mean FROM events GROUP BY 1, 2")
def stream_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = run.complete(P.windowed(P.read_events(spark, f"{sf_dir}/events.parquet")))
    return rows.select(F.unix_seconds("start").alias("start_s"), "event_type", "n", F.round("mean", 6).alias("mean"))


@query("SELECT user_id, event_id, event_type, value FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1")
def stream_latest_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    return run.complete(P.latest_state(P.read_events(spark, f"{sf_dir}/events.parquet")))


STEPS = ", ".join(f"('{before}', '{after}')" for before, some in NEXT.items() for after in some)
WALK = f"""WITH RECURSIVE steps(x, y) AS (VALUES {STEPS}),
e AS MATERIALIZED (SELECT user_id, event_id, {STATES} AS status, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS n FROM events),
walk AS (SELECT user_id, n, event_id, 'pending' AS before, status AS after, ('pending', status) IN (SELECT (x, y) FROM steps) AS valid FROM e WHERE n = 1 UNION ALL
  SELECT e.user_id, e.n, e.event_id, CASE WHEN valid THEN after ELSE before END, e.status, (CASE WHEN valid THEN after ELSE before END, e.status) IN (SELECT (x, y) FROM steps)
  FROM walk w JOIN e ON e.user_id = w.user_id AND e.n = w.n + 1)
SELECT user_id AS process_id, event_id AS sequence, before, after, valid FROM walk"""


@query(WALK)
def stream_transitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """State machine of each user's process; the SQL walks each user's events by their number."""
    events = P.read_events(spark, f"{sf_dir}/events.parquet").select(F.col("user_id").alias("process_id"), F.col("event_id").alias("sequence"), F.expr(STATES).alias("status"))
    return run.appended(P.checked_transitions(events))


LATEST = """WITH good AS (SELECT * FROM events WHERE value IS NULL OR value < 150),
  half AS (SELECT *, event_id % 2 AS h, row_number() OVER (PARTITION BY user_id, event_id % 2 ORDER BY ts DESC, event_id DESC) AS n FROM good),
  last AS (SELECT *, min(h) OVER (PARTITION BY user_id) AS first_h, max(h) OVER (PARTITION BY user_id) AS last_h FROM half WHERE n = 1)
SELECT user_id, max(CASE WHEN h = first_h THEN event_id END) AS first_id, max(CASE WHEN h = last_h THEN event_id END) AS event_id,
  max(CASE WHEN h = last_h THEN event_type END) AS event_type, max(CASE WHEN h = last_h THEN value END) AS value FROM last GROUP BY user_id"""


@query(LATEST)
def keyed_upserts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two batches of events, merged by user into a table of partitions; values of 150 and more are rejected, and the first
    event's number is not among the columns that an upsert changes."""
    newest = lambda: [F.desc("ts"), F.desc("event_id")]
    kept = KeyedTable(run.folder(spark), ["user_id"], ["event_id", "ts", "event_type", "value"], newest, parts=8, rules=lambda: {"value": F.col("value") < 150})
    events = spark.read.parquet(f"{sf_dir}/events.parquet").select("user_id", F.col("event_id").alias("first_id"), "event_id", "ts", "event_type", "value")
    for half in (0, 1):
        merge_batch(kept, events.where(F.col("event_id") % 2 == half), half)
    return kept.rows(spark).select("user_id", "first_id", "event_id", "event_type", "value")
