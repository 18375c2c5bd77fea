"""Streaming queries: inputs arrive in steps, jobs restart at each step, results equal their batch form."""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


from countygeo.operators import sampling as sm
from countygeo.plans import collect
from countygeo.plans import fixtures as fx
from countygeo.plans.registry import query, r6
from countygeo.runtime import checkpoint, scratch_path
from countygeo.streaming import ingest as st

# Steps in which a table arrives. A job is drained and restarted at each, so state crosses restarts.
STEPS = 5
DELAY = "2 days"


def arriving(df: DataFrame, step: str = "step") -> Iterator[DataFrame]:
    """A table as a stream of files, which grows by the rows of one step before it is yielded again."""
    spark = df.sparkSession
    staged, path = checkpoint(df), scratch_path(spark, "source")
    schema = df.drop(step).schema
    for k in range(STEPS):
        staged.where(F.col(step) == k).drop(step).write.mode("append").parquet(path)
        yield spark.readStream.schema(schema).parquet(path)


def drained(df: DataFrame, job: Callable[[DataFrame], DataFrame], mode: str, keys: list[str] | None = None) -> DataFrame:
    """Result of a streaming job over ``df``, restarted from its checkpoint for every step."""
    spark = df.sparkSession
    base = scratch_path(spark, "stream")
    for stream in arriving(df):
        result = job(stream)
        st.run_available(result, st.table_sink(f"{base}/out"), mode, f"{base}/checkpoint")
    rows = st.read_sink(spark, f"{base}/out", result.schema)
    if mode == "complete":
        return st.last_batch(rows)
    return st.newest_rows(rows, keys) if keys else rows.drop("batch")


def in_no_order(df: DataFrame, *key: str) -> DataFrame:
    """Rows dealt to steps by a hash."""
    return df.withColumn("step", F.pmod(F.xxhash64(*key), F.lit(STEPS)).cast("int"))


def in_time(df: DataFrame) -> DataFrame:
    """Rows that arrive by their day, six days a step.

    A tenth of those of a step's last day come a step late, within the delay of
    the jobs; one in 97 of the first step comes with the last, far beyond it.
    """
    day = F.dayofmonth("updated") - 1
    regular = F.least(F.floor(day / 6), F.lit(STEPS - 1))
    late = (F.col("event_id") % 10 == 0) & (day % 6 == 5) & (regular < STEPS - 1)
    return df.withColumn("step", F.when((F.col("event_id") % 97 == 0) & (regular == 0), STEPS - 1)
                         .otherwise(regular + late.cast("int")).cast("int"))


#: Rows in time, and the watermark after the last step.
_TIMELY = {
    "fx_timely": "SELECT * FROM fx_fetch_log WHERE NOT (event_id % 97 = 0 AND day(updated) <= 6)",
    "fx_mark": "SELECT date_trunc('millisecond', max(updated)) - INTERVAL 2 days AS mark FROM fx_fetch_log",
}


def event_log(spark, sf):
    return fx.fetch_states(fx.table(spark, sf, "events"))


@query("stream_state", "SELECT key, state, bytes, event_id FROM fx_state")
def stream_state(spark, sf):
    out = drained(in_no_order(event_log(spark, sf), "event_id"), st.latest_state, "update", ["key"])
    return out.select("key", "state", "bytes", "event_id")


@query("stream_first", """
SELECT key, event_id, state, bytes, epoch_us(updated)::BIGINT AS at FROM (
  SELECT *, row_number() OVER (PARTITION BY key, s ORDER BY updated, event_id) AS rn, max(updated) OVER (PARTITION BY key, s) AS newest FROM (
    SELECT *, sum(fresh) OVER (PARTITION BY key ORDER BY updated, event_id) AS s FROM (
      SELECT *, CASE WHEN updated - lag(updated) OVER (PARTITION BY key ORDER BY updated, event_id) < INTERVAL 12 hours THEN 0 ELSE 1 END AS fresh
      FROM fx_timely))) JOIN fx_mark ON newest + INTERVAL 12 hours <= mark WHERE rn = 1""", _TIMELY)
def stream_first(spark, sf):
    """First insert of each key, and again after twelve silent hours."""
    out = drained(in_time(event_log(spark, sf)), lambda s: st.first_insert(s, delay=DELAY, keep="12 hours"), "append")
    return out.select("key", "event_id", "state", "bytes", F.unix_micros("updated").alias("at"))


@query("stream_progress", """
SELECT epoch(w)::BIGINT AS start, count(*) AS n, count(*) FILTER (state = 'done') AS ok,
  count(*) FILTER (state IN ('fail', 'meta_fail')) AS failed, round(count(*) / 15.0, 6) AS rate
FROM (SELECT *, time_bucket(INTERVAL 15 seconds, updated) AS w FROM fx_timely) JOIN fx_mark ON w + INTERVAL 15 seconds <= mark GROUP BY w""", _TIMELY)
def stream_progress(spark, sf):
    out = drained(in_time(event_log(spark, sf)), lambda s: st.progress(s, DELAY), "append")
    return out.select(F.unix_timestamp("start").alias("start"), "n", "ok", "failed", r6("rate").alias("rate"))


@query("stream_thin", """
SELECT adcode, gx, gy, panoid, lng, lat FROM (
  SELECT *, row_number() OVER (PARTITION BY adcode, gx, gy ORDER BY panoid) AS rn FROM (
    SELECT *, trunc(lng * 111320.0 * greatest(cos(radians(lat)), 1e-6) / 300.0)::BIGINT AS gx, trunc(lat * 111320.0 / 300.0)::BIGINT AS gy
    FROM fx_kept)) WHERE rn = 1""")
def stream_thin(spark, sf):
    out = drained(in_no_order(collect.kept_scan(spark, sf), "panoid"), st.thin_first, "update", ["adcode", "gx", "gy"])
    return out.select("adcode", "gx", "gy", "panoid", "lng", "lat")


@query("stream_reservoir", "SELECT * FROM fx_reservoir")
def stream_reservoir(spark, sf):
    path = scratch_path(spark, "reservoir")
    for stream in arriving(in_no_order(sm.candidates(collect.kept_scan(spark, sf)), "panoid")):
        kept = st.streamed_reservoir(stream, path, **collect.QUOTAS)
    return kept


@query("stream_restart", """
SELECT run, n, keys, finished, (SELECT count(DISTINCT key) FROM fx_runs b WHERE b.run <= r.run) - finished AS unfinished FROM (
  SELECT run, count(*) AS n, count(DISTINCT key) AS keys FROM fx_runs GROUP BY run) r JOIN (
  SELECT run, count(*) FILTER (state IN ('done', 'fail', 'meta_fail')) AS finished FROM (
    SELECT r.run, key, arg_max(state, {'u': updated, 'e': event_id}) AS state
    FROM (SELECT DISTINCT run FROM fx_runs) r JOIN fx_runs a ON a.run <= r.run GROUP BY ALL) GROUP BY run) USING (run)""",
       {"fx_runs": "SELECT *, least((day(updated) - 1) // 6, 4)::INT AS run FROM fx_fetch_log"})
def stream_restart(spark, sf):
    """Rows that each run of a restarted job reads, and the keys it leaves unfinished."""
    base = scratch_path(spark, "restart")
    log = event_log(spark, sf).withColumn("step", F.least(F.floor((F.dayofmonth("updated") - 1) / 6), F.lit(STEPS - 1)).cast("int"))
    bounds = []
    for stream in arriving(log):
        st.run_available(stream, st.table_sink(f"{base}/out"), "append", f"{base}/checkpoint")
        bounds.append(st.committed(spark, f"{base}/checkpoint"))
    rows = st.read_sink(spark, f"{base}/out", stream.schema)
    # The run of a batch is the number of runs that had ended before it.
    run = sum(((F.col("batch") > F.lit(b)).cast("int") for b in bounds[1:]), (F.col("batch") > F.lit(bounds[0])).cast("int"))
    rows = checkpoint(rows.withColumn("run", run))
    read = rows.groupBy("run").agg(F.count("*").alias("n"), F.count_distinct("key").alias("keys"))
    # A row counts for its own run and all later ones; there are STEPS runs.
    so_far = rows.withColumn("run", F.explode(F.sequence("run", F.lit(STEPS - 1))))
    state = so_far.groupBy("run", "key").agg(F.max_by("state", F.struct("updated", "event_id")).alias("state"))
    ended = F.count_if(F.col("state").isin("done", "fail", "meta_fail"))
    return read.join(state.groupBy("run").agg(ended.alias("finished"), (F.count("*") - ended).alias("unfinished")), "run")


@query("stream_counts", "SELECT adcode, substr(adcode, 1, 2) || '0000' AS province, count(*) AS n FROM fx_kept GROUP BY 1, 2")
def stream_counts(spark, sf):
    out = drained(in_no_order(collect.kept_scan(spark, sf), "panoid"), st.county_counts, "complete")
    return out.withColumnRenamed("count", "n")


@query("stream_results", """
SELECT p.panoid, coalesce(ok, false) AS ok, CASE WHEN ok IS NULL THEN 'absent' ELSE error END AS error, online_lng, online_lat, seconds
FROM fx_panos p LEFT JOIN (SELECT * FROM fx_results QUALIFY row_number() OVER (PARTITION BY panoid ORDER BY line DESC) = 1) r
ON r.panoid = p.panoid""", {"fx_results": """
SELECT panoid, line, line % 4 <> 0 AS ok, CASE WHEN line % 4 <> 0 THEN lng END AS online_lng, CASE WHEN line % 4 <> 0 THEN lat END AS online_lat,
  CASE WHEN line % 4 = 0 THEN 'timeout' END AS error, (line % 50)::DOUBLE AS seconds
FROM (SELECT panoid, lng, lat, k * 3 + unnest(range(k % 4)) AS line FROM (SELECT *, substr(panoid, 17, 9)::BIGINT AS k FROM fx_panos))"""})
def stream_results(spark, sf):
    """Log of fetch results, up to three tries an id: the last line of an id stands, ids without one are absent."""
    panos = checkpoint(fx.panos(spark, sf).select("panoid", "lng", "lat"))
    k = F.substring("panoid", 17, 9).cast("bigint")
    tries = panos.withColumn("k", k).where("k % 4 > 0").select(
        "panoid", "lng", "lat", F.explode(F.sequence(F.col("k") * 3, F.col("k") * 3 + F.col("k") % 4 - 1)).alias("line"))
    ok = F.col("line") % 4 != 0
    log = tries.select("panoid", "line", ok.alias("ok"), F.when(ok, F.col("lng")).alias("online_lng"), F.when(ok, F.col("lat")).alias("online_lat"),
                       F.when(~ok, "timeout").alias("error"), (F.col("line") % 50).cast("double").alias("seconds"))
    base = scratch_path(spark, "results")
    # Ids keep coming and none is ever closed: what is known of them stays in the sink, not in the state of the job.
    for stream in arriving(in_no_order(log, "line")):
        st.run_available(stream, st.latest_sink(f"{base}/out", "panoid", ["line"]), "append", f"{base}/checkpoint")
    last = st.read_latest(spark, f"{base}/out", stream.schema, "panoid", ["line"])
    return panos.select("panoid").join(last, "panoid", "left").select(
        "panoid", F.coalesce("ok", F.lit(False)).alias("ok"), F.when(F.col("ok").isNull(), "absent").otherwise(F.col("error")).alias("error"),
        "online_lng", "online_lat", "seconds")


@query("stream_passes", """
SELECT vehicle, epoch(day)::BIGINT AS day, count(*) AS n FROM (SELECT vehicle, strptime(date, '%Y%m%d') AS day FROM fx_samples)
WHERE day + INTERVAL 2 days <= (SELECT max(strptime(date, '%Y%m%d')) FROM fx_samples) GROUP BY ALL""")
def stream_passes(spark, sf):
    """Rows of each vehicle and day, for the days closed a day after their end."""
    day = F.to_timestamp("date", "yyyyMMdd")
    rows = fx.samples(spark, sf).select("panoid", "vehicle", day.alias("day"))
    out = drained(rows.withColumn("step", F.least(F.year("day") - 1992, F.lit(STEPS - 1))), st.passes, "append")
    return out.select("vehicle", F.unix_timestamp("day").alias("day"), F.col("count").alias("n"))


@query("stream_sessions", """
SELECT key, epoch_us(min(updated))::BIGINT AS start, count(*) AS n FROM (
  SELECT *, sum(fresh) OVER (PARTITION BY key ORDER BY updated, event_id) AS s FROM (
    SELECT *, CASE WHEN updated - lag(updated) OVER (PARTITION BY key ORDER BY updated, event_id) < INTERVAL 6 hours THEN 0 ELSE 1 END AS fresh
    FROM fx_timely)) GROUP BY key, s HAVING max(updated) + INTERVAL 6 hours <= (SELECT mark FROM fx_mark)""", _TIMELY)
def stream_sessions(spark, sf):
    out = drained(in_time(event_log(spark, sf)), lambda s: st.sessions(s, gap="6 hours", delay=DELAY), "append")
    return out.select("key", F.unix_micros("start").alias("start"), "n")


@query("stream_steps", """
SELECT w AS start, round(avg(bytes), 6) AS mean, count(*) AS n FROM (
  SELECT epoch(time_bucket(INTERVAL 5 minutes, updated))::BIGINT - unnest([0, 300, 600, 900]) AS w, bytes FROM fx_timely)
JOIN fx_mark ON w + 1200 <= epoch(mark) GROUP BY w""", _TIMELY)
def stream_steps(spark, sf):
    rows = event_log(spark, sf).withColumn("value", F.col("bytes").cast("double"))
    out = drained(in_time(rows), lambda s: st.step_means(s, DELAY), "append")
    return out.select(F.unix_timestamp("start").alias("start"), r6("mean").alias("mean"), "n")
