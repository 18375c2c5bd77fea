import random

import numpy as np
from pyspark.sql import functions as F

from countygeo.operators import ranking as rk


def test_top_k_with_a_hot_key(spark):
    df = spark.range(3000).select(F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("k"), F.col("id") % 50)).alias("k"),
                                  F.md5(F.col("id").cast("string")).alias("o")).repartition(7)
    got = {(r.k, r.o) for r in rk.top_k_per_key(df, ["k"], ["o"], 5, fan_in=3).collect()}
    rows = {}
    for r in df.collect():
        rows.setdefault(r.k, []).append(r.o)
    assert got == {(k, o) for k, v in rows.items() for o in sorted(v)[:5]}


def test_group_limit_reaches_the_plan(spark):
    df = spark.range(100).select((F.col("id") % 3).alias("k"), F.col("id").alias("o"))
    plan = rk.top_k_per_key(df, ["k"], ["o"], 5)._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan


def test_hash_rank_is_a_global_rank(spark):
    df = spark.range(2000).select("id", F.md5(F.col("id").cast("string")).alias("h"))
    rows = rk.hash_rank(df, "h").orderBy("h").collect()
    assert [r["rank"] for r in rows] == list(range(1, 2001))


def test_prefix_sums_and_ranks(spark):
    df = spark.range(500).select(F.format_string("%05d", F.col("id") * 7919 % 500).alias("k"), (F.col("id") % 13).alias("v"))
    for range_rows in (7, 100, 10_000):
        rows = rk.prefix_sums(df, ["k"], {"before": F.col("v"), "pos": F.lit(1)}, range_rows).orderBy("k").collect()
        total = 0
        for i, r in enumerate(rows):
            assert (r.before, r.pos) == (total, i)
            total += r.v
    assert rk.prefix_sums(df.where("v > 99"), ["k"], {"before": F.col("v")}).count() == 0


def test_prefix_sums_shuffle_rows_once_into_ranges_of_bounded_rows(spark):
    # Half of the keys lie in a narrow part of their domain, and a value is null.
    df = spark.range(4000).select(F.when(F.col("id") % 2 == 0, F.col("id") * 1e-6).otherwise(F.col("id") * 1e6).alias("k"),
                                  F.when(F.col("id") != 7, 1).alias("v"))
    before = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        for partitions in ("1", "13"):
            spark.conf.set("spark.sql.shuffle.partitions", partitions)
            out = rk.prefix_sums(df, ["k"], {"at": F.lit(1), "sum": F.col("v")}, 100)
            plan = out._jdf.queryExecution().optimizedPlan().toString()
            assert "Repartition" not in plan and "Window" not in plan
            stored = spark.read.parquet(next(iter(out.inputFiles())).rsplit("/", 1)[0])
            sizes = [r["count"] for r in stored.groupBy("__part").count().collect()]
            assert max(sizes) <= 300 and sum(sizes) == 4000
            rows = out.orderBy("k").collect()
            assert [r["at"] for r in rows] == list(range(4000)) and rows[-1]["sum"] == 3998
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def test_rolling_frame_crosses_blocks(spark):
    df = spark.range(200).select((F.col("id") % 2).alias("e"), F.col("id").alias("t"), F.col("id").cast("double").alias("v"))
    got = {r.t: r.m for r in rk.rolling_frame(df, ["t"], 5, {"m": F.avg("v")}, ["e"], block_rows=16).collect()}
    for e in (0, 1):
        ts = [t for t in range(200) if t % 2 == e]
        for i, t in enumerate(ts):
            assert abs(got[t] - np.mean(ts[max(0, i - 4):i + 1])) < 1e-9


def test_quantiles_with_copies_and_sentinels(spark):
    rng = random.Random(3)
    values = [("a", 7.5)] * 400 + [("a", rng.uniform(0, 50)) for _ in range(333)] + [("b", 1e9), ("b", 2.0), ("b", 2.0001)]
    df = spark.createDataFrame(values, "k string, v double")
    got = {r.k: r for r in rk.linear_quantiles(df, ["k"], "v", {"q25": 0.25, "q50": 0.5, "q90": 0.9}).collect()}
    for key in "ab":
        v = [x for k, x in values if k == key]
        assert np.allclose([got[key].q25, got[key].q50, got[key].q90], np.percentile(v, [25, 50, 90]))
    a = sorted(x for k, x in values if k == "a")
    picked = {r.k: r for r in rk.picked_quantiles(df, ["k"], "v", {"p10": 10, "p75": 75}).collect()}
    assert picked["a"].p10 == a[int(len(a) * 10 / 100)] and picked["a"].p75 == a[int(len(a) * 75 / 100)]
    assert picked["b"].p75 == 1e9
