"""Job roll-ups and log metrics over `events`: users are shards of jobs, event types are states."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from galleria.functions.display import eta_seconds, status_label
from galleria.functions.identity import derived_id
from galleria.operators import jobs as J, metrics as M
from galleria.plans.registry import query, table
from galleria.plans.scalars import sql_uuid5

SHARDS = """WITH shards AS (SELECT user_id % 20 AS job_id, CASE arg_max(event_type, ts) WHEN 'error' THEN 'failed' WHEN 'purchase' THEN 'cancelled' WHEN 'signup' THEN 'running' ELSE 'completed' END AS status,
  CAST(count_if(event_type = 'view') AS BIGINT) AS enrolled, CAST(count_if(event_type = 'click' AND value > 100) AS BIGINT) AS no_face, CAST(count_if(value > 150) AS BIGINT) AS decode, CAST(count_if(value > 190 AND user_id % 3 = 0) AS BIGINT) AS failed, count(*) * 40 AS discovered,
  count_if(value > 195 AND user_id % 7 = 0) > 0 AS fatal, CAST(count(*) AS DOUBLE) / 4 AS seconds FROM events GROUP BY user_id) """


def shards(spark: SparkSession, d: str) -> DataFrame:
    kind, value, user = F.col("event_type"), F.col("value"), F.col("user_id")
    last = F.max_by("event_type", "ts")
    return table(spark, d, "events").groupBy("user_id").agg(
        F.when(last == "error", "failed").when(last == "purchase", "cancelled").when(last == "signup", "running").otherwise("completed").alias("status"),
        F.count_if(kind == "view").alias("enrolled"),
        F.count_if((kind == "click") & (value > 100)).alias("no_face"),
        F.count_if(value > 150).alias("decode"),
        F.count_if((value > 190) & (user % 3 == 0)).alias("failed"),
        (F.count("*") * 40).alias("discovered"),
        (F.count_if((value > 195) & (user % 7 == 0)) > 0).alias("fatal"),
        (F.count("*").cast("double") / 4).alias("seconds"),
    ).withColumn("job_id", F.col("user_id") % 20)


ROLLED = SHARDS + """, rolled AS (SELECT job_id, CAST(sum(enrolled) AS BIGINT) AS enrolled, CAST(sum(no_face) AS BIGINT) AS no_face, CAST(sum(decode) AS BIGINT) AS decode, CAST(sum(failed) AS BIGINT) AS failed, CAST(sum(discovered) AS BIGINT) AS discovered,
  bool_or(fatal) AS fatal, count(*) AS n_shards, CAST(count_if(status = 'failed') AS BIGINT) AS n_failed, CAST(count_if(status = 'cancelled') AS BIGINT) AS n_cancelled, CAST(count_if(status = 'running') AS BIGINT) AS n_running, max(seconds) AS seconds FROM shards GROUP BY job_id) """


@query(ROLLED + "SELECT job_id, enrolled, no_face, decode, failed, discovered, fatal, n_shards, n_failed, n_cancelled, n_running, n_shards - n_failed - n_cancelled - n_running AS n_completed FROM rolled")
def shard_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return J.aggregate_jobs(shards(spark, sf_dir)).drop("seconds", "status", "outcome", "rate")


@query(ROLLED + """SELECT job_id, CASE WHEN fatal OR failed > 0 OR (no_face + decode) / greatest(discovered, 1) > 0.03 THEN 'failed' WHEN no_face + decode > 0 THEN 'completed_with_warnings' ELSE 'completed' END AS outcome,
  CASE WHEN n_cancelled > 0 AND n_running = 0 AND n_failed = 0 THEN 'cancelled' WHEN n_failed > 0 THEN 'failed' ELSE 'completed' END AS status FROM rolled""")
def job_outcome(spark: SparkSession, sf_dir: str) -> DataFrame:
    return J.aggregate_jobs(shards(spark, sf_dir)).select("job_id", "outcome", "status")


@query(ROLLED + "SELECT job_id, CASE WHEN seconds > 0 THEN round(enrolled / seconds, 2) ELSE 0 END AS rate, round((discovered - enrolled) / nullif(CASE WHEN seconds > 0 THEN round(enrolled / seconds, 2) ELSE 0 END, 0), 6) AS eta FROM rolled")
def job_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = J.aggregate_jobs(shards(spark, sf_dir))
    return rows.select("job_id", "rate", F.round(eta_seconds(F.col("discovered") - F.col("enrolled"), F.col("rate")), 6).alias("eta"))


@query(f"""WITH jobs AS (SELECT user_id AS job_id, CASE WHEN user_id % 2 = 0 THEN max(CAST(json_extract_string(props, '$.k') AS BIGINT)) * 7 END AS requested, count(*) * 5 AS discovered, 400 AS target, user_id * 4 AS active FROM events GROUP BY user_id),
  b AS (SELECT *, least(coalesce(requested, discovered), greatest(0, target - active), discovered) AS budget FROM jobs)
  SELECT job_id, CAST(i AS INTEGER) AS shard_index, CAST((budget + 3) // 4 AS BIGINT) AS max_photos, {sql_uuid5("'shard:' || job_id || ':' || i", "process")} AS process_id FROM b, unnest(range(0, 4)) AS u(i) WHERE budget > 0""")
def job_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.get_json_object("props", "$.k").cast("long")
    jobs = table(spark, sf_dir, "events").groupBy(F.col("user_id").alias("job_id")).agg(F.when(F.col("user_id") % 2 == 0, F.max(k) * 7).alias("requested"), (F.count("*") * 5).alias("discovered"))
    return J.plan_jobs(jobs.withColumns({"target": F.lit(400), "active": F.col("job_id") * 4}), 4)


@query("""SELECT event_id, CASE event_type WHEN 'click' THEN 'cancel_requested' WHEN 'view' THEN 'cancelling' WHEN 'signup' THEN 'cancel_requested' ELSE s END AS after, CASE s WHEN 'running' THEN 'Running' WHEN 'cancel_requested' THEN 'Cancel requested' WHEN 'pending' THEN 'Pending' WHEN 'failed' THEN 'Failed' ELSE 'Completed' END AS label
  FROM (SELECT *, CASE event_type WHEN 'click' THEN 'running' WHEN 'view' THEN 'cancel_requested' WHEN 'signup' THEN 'pending' WHEN 'error' THEN 'failed' ELSE 'completed' END AS s FROM events)""")
def job_cancel(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.col("event_type")
    s = F.when(kind == "click", "running").when(kind == "view", "cancel_requested").when(kind == "signup", "pending").when(kind == "error", "failed").otherwise("completed")
    return table(spark, sf_dir, "events").select("event_id", J.cancelled(s).alias("after"), status_label(s).alias("label"))


@query("""WITH e AS (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY ts DESC, event_id DESC) AS n FROM events)
SELECT event_type, count(*) AS n, round(quantile_cont(value, 0.5), 6) AS p50, round(quantile_cont(value, 0.95), 6) AS p95, round(avg(value), 6) AS mean, round(stddev_pop(value), 6) AS std FROM e GROUP BY event_type""")
def latency_percentiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = M.exact_percentiles(table(spark, sf_dir, "events"), ["event_type"], "value", [0.5, 0.95])
    return rows.select("event_type", "n", *[F.round(c, 6).alias(c) for c in ("p50", "p95", "mean", "std")])


@query("""WITH e AS (SELECT * FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) <= 60)
SELECT user_id, count(*) AS n, round(quantile_cont(value, 0.5), 6) AS p50, round(quantile_cont(value, 0.95), 6) AS p95 FROM e GROUP BY user_id""")
def last60(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = M.last_n(table(spark, sf_dir, "events"), ["user_id"], [F.desc("ts"), F.desc("event_id")])
    return M.percentiles(rows, ["user_id"], "value", [0.5, 0.95]).select("user_id", "n", F.round("p50", 6).alias("p50"), F.round("p95", 6).alias("p95"))


@query("""WITH e AS (SELECT event_id, user_id, CAST(floor(epoch(ts)) AS BIGINT) AS s, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS done FROM events)
SELECT event_id, round(coalesce((done - min(done) OVER w) / nullif(CAST(s - min(s) OVER w AS DOUBLE), 0), 0), 9) AS rate FROM e WINDOW w AS (PARTITION BY user_id ORDER BY s RANGE BETWEEN 86400 PRECEDING AND CURRENT ROW)""")
def trailing_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events of each user over the last day, per second."""
    done = F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id"))
    rows = table(spark, sf_dir, "events").select("event_id", "user_id", F.unix_seconds(F.col("ts").cast("timestamp")).alias("s"), done.alias("done"))
    return M.trailing_rate(rows, ["user_id"], "s", "done", 86400).select("event_id", F.round("rate", 9).alias("rate"))


@query("SELECT event_id, round(epoch(ts) - lag(epoch(ts)) OVER (PARTITION BY user_id ORDER BY ts, event_id), 3) AS gap FROM events")
def row_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    seconds = F.unix_micros(F.col("ts").cast("timestamp")) / 1e6
    return M.row_rate(table(spark, sf_dir, "events"), ["user_id"], [F.col("ts"), F.col("event_id")], seconds).select("event_id", F.round("gap", 3).alias("gap"))


@query("SELECT user_id, event_id, event_type, value FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1")
def latest_state_per_process(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.latest(table(spark, sf_dir, "events"), ["user_id"], ["ts", "event_id"]).select("user_id", "event_id", "event_type", "value")


@query('SELECT before, event_type AS "after", count(*) AS n FROM (SELECT event_type, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS before FROM events) WHERE before IS NOT NULL GROUP BY 1, 2')
def event_transitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.transitions(table(spark, sf_dir, "events"), ["user_id"], [F.col("ts"), F.col("event_id")], "event_type")


RECORDS = f"""WITH parents AS (SELECT user_id % 20 AS job_id, min(ts) AS started, CASE WHEN user_id % 20 % 3 <> 0 THEN max(ts) END AS completed FROM events GROUP BY user_id % 20, CASE WHEN user_id % 20 % 3 <> 0 THEN 1 END),
shards AS (SELECT job_id, CAST(i AS INTEGER) AS shard_index, {sql_uuid5("'shard:' || job_id || ':' || i", "process")} AS process_id FROM parents, unnest(range(0, 5)) AS u(i)),
counted AS (SELECT user_id % 20 AS job_id, CAST(user_id // 20 % 4 AS INTEGER) AS shard_index, CASE WHEN max(value) > 199.9 THEN 'failed' WHEN count(*) % 5 = 0 THEN 'cancelled' WHEN count(*) % 3 = 0 THEN 'running' ELSE 'completed' END AS status, CAST(count_if(event_type = 'view') AS BIGINT) AS enrolled, count(*) AS discovered FROM events GROUP BY 1, 2),
joined AS (SELECT s.job_id, coalesce(c.status, 'queued') AS status, c.enrolled, c.discovered FROM shards s LEFT JOIN counted c USING (job_id, shard_index)) """


def parents(spark: SparkSession, d: str) -> DataFrame:
    """Jobs of five shards each; every third one still runs."""
    ts, job = F.col("ts").cast("timestamp"), (F.col("user_id") % 20).alias("job_id")
    rows = table(spark, d, "events").groupBy(job).agg(F.min(ts).alias("started"), F.max(ts).alias("last"))
    shards_of = F.transform(F.sequence(F.lit(0), F.lit(4)), lambda i: F.struct(i.alias("shard_index")))
    return rows.select("job_id", shards_of.alias("shards"), "started", F.when(F.col("job_id") % 3 != 0, F.col("last")).alias("completed"), F.lit("2030-01-01 00:00:00").cast("timestamp").alias("as_of"))


def records(spark: SparkSession, d: str) -> DataFrame:
    """Records of four of the five shards."""
    rows = table(spark, d, "events").groupBy((F.col("user_id") % 20).alias("job"), (F.floor(F.col("user_id") / 20) % 4).cast("int").alias("shard")).agg(F.max("value").alias("v"), F.count("*").alias("n"), F.count_if(F.col("event_type") == "view").alias("enrolled"))
    status = F.when(F.col("v") > 199.9, "failed").when(F.col("n") % 5 == 0, "cancelled").when(F.col("n") % 3 == 0, "running").otherwise("completed")
    zero = F.lit(0).cast("long")
    return rows.select(derived_id("process", F.concat_ws(":", F.lit("shard"), F.col("job").cast("string"), F.col("shard").cast("string"))).alias("process_id"), status.alias("status"), "enrolled", zero.alias("no_face"), zero.alias("decode"), zero.alias("failed"), F.col("n").alias("discovered"), F.lit(False).alias("fatal"), F.lit(None).cast("double").alias("seconds"))


@query(RECORDS + """SELECT job_id, CAST(sum(coalesce(enrolled, 0)) AS BIGINT) AS enrolled, CAST(sum(coalesce(discovered, 0)) AS BIGINT) AS discovered, count(*) AS n_shards, CAST(count_if(status = 'failed') AS BIGINT) AS n_failed, CAST(count_if(status = 'cancelled') AS BIGINT) AS n_cancelled,
  CAST(count_if(status IN ('running', 'queued')) AS BIGINT) AS n_running, round(epoch(any_value(coalesce(completed, TIMESTAMP '2030-01-01'))) - epoch(any_value(started)), 3) AS seconds,
  CASE WHEN epoch(any_value(coalesce(completed, TIMESTAMP '2030-01-01'))) > epoch(any_value(started)) THEN round(sum(coalesce(enrolled, 0)) / (epoch(any_value(coalesce(completed, TIMESTAMP '2030-01-01'))) - epoch(any_value(started))), 2) ELSE 0 END AS rate
  FROM joined JOIN parents USING (job_id) GROUP BY job_id""")
def job_progress(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Jobs over the records of their shards; a shard without a record is queued."""
    rows = J.job_progress(parents(spark, sf_dir), records(spark, sf_dir))
    return rows.select("job_id", "enrolled", "discovered", "n_shards", "n_failed", "n_cancelled", "n_running", F.round("seconds", 3).alias("seconds"), "rate")


@query("SELECT event_id AS process_id, event_type AS process_type, value FROM events WHERE event_type = 'purchase'")
def jobs_of_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").select(F.col("event_id").alias("process_id"), F.col("event_type").alias("process_type"), "value")
    return J.of_type(rows, "purchase")


@query("""WITH log AS (SELECT user_id, event_type, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS sequence FROM events WHERE event_id % 2 = 0),
  last AS (SELECT user_id, max(sequence) AS done, arg_max(event_type, sequence) AS state FROM log GROUP BY user_id)
  SELECT e.user_id AS process_id, coalesce(done, 0) + row_number() OVER w AS sequence, 'status' AS event_type, CASE WHEN row_number() OVER w = 1 THEN state ELSE lag(e.event_type) OVER w END AS before, e.event_type AS "after", 'event ' || event_id AS message
  FROM events e LEFT JOIN last USING (user_id) WHERE event_id % 2 = 1 WINDOW w AS (PARTITION BY e.user_id ORDER BY event_id)""")
def event_append(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events with odd ids, appended to a log of those with even ids."""
    e = table(spark, sf_dir, "events")
    log = e.where("event_id % 2 = 0").select(F.col("user_id").alias("process_id"), F.row_number().over(Window.partitionBy("user_id").orderBy("event_id")).alias("sequence"), F.col("event_type").alias("after"))
    changes = e.where("event_id % 2 = 1").select(F.col("user_id").alias("process_id"), F.lit("status").alias("event_type"), F.col("event_type").alias("after"), F.concat(F.lit("event "), F.col("event_id").cast("string")).alias("message"), "event_id")
    return J.append_events(log, changes, ["event_id"])


@query(f"""WITH stored AS (SELECT user_id % 30 AS k, CASE user_id % 30 % 3 WHEN 0 THEN 'completed' WHEN 1 THEN 'failed' ELSE 'running' END AS status, count(*) AS result FROM events GROUP BY 1, 2),
  asked AS (SELECT DISTINCT user_id % 50 AS k FROM events)
  SELECT 'key-' || k AS idempotency_key, {sql_uuid5("'job:key-' || k", "process")} AS process_id, coalesce(status, 'running') = 'running' AS run, CASE WHEN status IN ('completed', 'failed') THEN result END AS result FROM asked LEFT JOIN stored USING (k)""")
def job_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Requests by their idempotency keys: ended jobs give their stored result, others have to run."""
    e = table(spark, sf_dir, "events")
    k = F.col("user_id") % 30
    status = F.when(k % 3 == 0, "completed").when(k % 3 == 1, "failed").otherwise("running")
    stored = e.groupBy(k.alias("k"), status.alias("status")).agg(F.count("*").alias("result"))
    stored = stored.select(derived_id("process", F.concat(F.lit("job:key-"), F.col("k").cast("string"))).alias("process_id"), "status", "result")
    return J.to_run(e.select(F.concat(F.lit("key-"), (F.col("user_id") % 50).cast("string")).alias("idempotency_key")), stored)


@query("WITH t AS (SELECT count(*) AS n FROM part) SELECT p_partkey, CAST((p_partkey - 1) % 3 AS INTEGER) AS stride, CAST(floor((p_partkey - 1) * 3 / n) AS INTEGER) AS run FROM part, t")
def split_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items dealt to three workers, in turn and in neighbouring runs."""
    rows = table(spark, sf_dir, "part").select((F.col("p_partkey") - 1).alias("i"), "p_partkey")
    total = rows.agg(F.count("*").alias("n"))
    return rows.join(F.broadcast(total)).select("p_partkey", J.split_by(F.col("i"), 3).alias("stride"), J.split_by(F.col("i"), 3, F.col("n")).alias("run"))


@query("""SELECT conv_id AS request_id, CASE WHEN conv_id % 9 = 0 THEN 'failed' ELSE 'completed' END AS status, CASE WHEN conv_id % 9 = 0 THEN 0 ELSE count_if(role = 'user') END::BIGINT AS face_count FROM conversations GROUP BY conv_id""")
def recognition_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """State of recognition requests: a ninth of the extractions failed."""
    c = table(spark, sf_dir, "conversations")
    requests = c.select(F.col("conv_id").alias("request_id"), (F.col("conv_id") % 9 != 0).alias("extracted")).distinct()
    return J.request_states(requests, c.where("role = 'user'").select(F.col("conv_id").alias("request_id")))
