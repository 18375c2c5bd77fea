"""Run-log queries over the event log as training steps."""

from __future__ import annotations

from pyspark.sql import functions as F

from countygeo.operators import runlog as rl
from countygeo.plans import fixtures as fx
from countygeo.plans import splitting
from countygeo.plans.registry import query, r6


def steps(spark, sf):
    """Steps in time order; an epoch is a user group."""
    e = fx.table(spark, sf, "events")
    return e.select(
        (F.col("user_id") % 10).cast("int").alias("epoch"), F.col("ts").alias("ts"), "event_id",
        (F.round(F.abs("value") * 100) / 100).alias("seconds"), F.abs("value").alias("loss"),
        F.when(F.col("event_type") == "purchase", 1).otherwise(0).alias("hits"),
        F.when(F.col("event_type") != "error", 1).otherwise(0).alias("known"))


_STEPS = """
SELECT (user_id % 10)::INT AS epoch, ts, event_id, round(abs(value) * 100) / 100 AS seconds, abs(value) AS loss,
  (event_type = 'purchase')::INT AS hits, (event_type <> 'error')::INT AS known FROM events"""
_SV = {"fx_steps": _STEPS}


@query("recent_mean", """
SELECT event_id, round(avg(seconds) OVER (PARTITION BY epoch ORDER BY ts, event_id ROWS BETWEEN 19 PRECEDING AND CURRENT ROW), 6) AS recent
FROM fx_steps""", _SV)
def recent_mean(spark, sf):
    out = rl.recent_means(steps(spark, sf), ["ts", "event_id"], {"recent": "seconds"}, 20, ["epoch"])
    return out.select("event_id", r6("recent").alias("recent"))


@query("running_mean", """
SELECT event_id, round(avg(seconds) OVER (ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING), 6) AS running FROM fx_steps""", _SV)
def running_mean(spark, sf):
    out = rl.running_mean(steps(spark, sf), ["ts", "event_id"], "seconds", "running")
    return out.select("event_id", r6("running").alias("running"))


def epochs(spark, sf):
    return rl.epoch_records(steps(spark, sf), 10, 8)


_EPOCHS = """
SELECT epoch, sum(loss) / greatest(1, count(*)) AS train_loss, sum(hits)::DOUBLE / greatest(1, sum(known)) AS train_acc, count(*) AS steps,
  sum(seconds) AS sec FROM fx_steps GROUP BY epoch"""


@query("epoch_record", """
SELECT epoch, round(train_loss, 5) AS train_loss, round(train_acc, 6) AS train_acc, steps,
  round(round(sec, 2) / 60, 1) AS minutes, round((10 - epoch - 1) * sec / 60, 4) AS eta_minutes FROM fx_epochs""",
       {**_SV, "fx_epochs": _EPOCHS})
def epoch_record(spark, sf):
    return epochs(spark, sf).select("epoch", F.round("train_loss", 5).alias("train_loss"), r6("train_acc").alias("train_acc"),
                                    "steps", "minutes", F.round("eta_minutes", 4).alias("eta_minutes"))


@query("best_epoch", """
SELECT epoch, round(train_acc, 6) AS train_acc,
  train_acc > coalesce(max(train_acc) OVER (ORDER BY epoch ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), -1) AS is_best FROM fx_epochs""",
       {**_SV, "fx_epochs": _EPOCHS})
def best_epoch(spark, sf):
    return rl.best_epochs(epochs(spark, sf), "train_acc").select("epoch", r6("train_acc").alias("train_acc"), "is_best")


@query("log_digest", "SELECT epoch, steps, round(train_acc, 6) AS train_acc FROM fx_epochs ORDER BY epoch DESC LIMIT 5",
       {**_SV, "fx_epochs": _EPOCHS})
def log_digest(spark, sf):
    return rl.log_digest(epochs(spark, sf), ["steps", "train_acc"]).withColumn("train_acc", r6("train_acc"))


@query("strided_parts", """
SELECT panoid, ((row_number() OVER (ORDER BY panoid) - 1) % 4)::INT AS part FROM fx_samples""")
def strided_parts(spark, sf):
    return rl.strided_part(fx.samples(spark, sf).select("panoid"), "panoid", 4)


@query("spot_check_keys", """
SELECT panoid FROM (SELECT panoid, row_number() OVER (ORDER BY panoid) - 1 AS i, count(*) OVER () AS n FROM fx_samples)
WHERE i % greatest(1, n // 12) = 0""")
def spot_check_keys(spark, sf):
    return rl.spot_checks(fx.samples(spark, sf), "panoid")


@query("stratified_subset", """
SELECT panoid, adcode FROM (
  SELECT panoid, adcode, row_number() OVER (PARTITION BY adcode ORDER BY md5('0|' || panoid), panoid) AS turn FROM fx_train)
ORDER BY turn, adcode LIMIT 300""")
def stratified_subset(spark, sf):
    split = splitting.split(spark, sf).where(F.col("split") == "train")
    train = fx.samples(spark, sf).join(split, "panoid", "left_semi").select("panoid", "adcode")
    return rl.stratified_subset(train, "panoid", "adcode", 300)
