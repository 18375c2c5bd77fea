"""Plans and steps whose cost must not grow faster than their input."""

import re
import tracemalloc

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from countygeo.operators import checks, splits
from countygeo.operators import labels as lb
from countygeo.operators import median as md
from countygeo.operators import vehicles as vh
from countygeo.plans import evaluation, vehicle
from countygeo.plans import fixtures as fx
from countygeo.sources import sinks

SF = "/root/testdata/sf0.001"


def plan_of(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_joins_on_ids_do_not_copy_the_expression_of_the_id(spark):
    samples = fx.samples(spark, SF)
    grouped = splits.with_group(samples.select("panoid", "vehicle", "date"))
    groups = grouped.select("gid").distinct()
    joined = samples.join(grouped.join(groups, "gid").select("panoid"), "panoid", "left_semi")
    # Three scans of the samples, each with one expression of the id.
    assert len(re.findall(r"lpad\(cast\(n#\d+ as string\), 3", plan_of(joined))) <= 3


def test_coverage_derives_each_id_once(spark):
    # What is parsed from the id must not copy its expression, which holds the only date_format.
    assert plan_of(vehicle.coverage(spark, SF)).count("date_format(") == 1


def test_coverage_labels_distinct_days_not_every_sample(spark):
    # Of the plan, what lies below the first distinct runs on each sample.
    above, _, below = plan_of(vehicle.coverage(spark, SF)).rpartition("Aggregate [")
    assert "date_format(" in below
    for made in ("split(", "upper(", "RLIKE("):
        assert made in above and made not in below


def test_an_empty_split_has_no_members_unless_they_are_required(spark):
    samples = spark.createDataFrame([("a", "510101"), ("b", "510102")], "panoid string, adcode string")
    split = spark.createDataFrame([("a", "train"), ("b", "test_county")], "panoid string, split string")
    assert checks.split_members(samples, split, "val_same", required=False).count() == 0
    with pytest.raises(ValueError):
        checks.split_members(samples, split, "val_same")


def test_vehicle_classes_start_from_one_run_over_the_samples(spark):
    seen = spark.sparkContext.accumulator(0)

    def count(batches):
        for batch in batches:
            seen.add(batch.num_rows)
            yield batch

    days = spark.createDataFrame([(f"V{i % 2}", f"d{i}", 9) for i in range(8)], "vehicle string, date string, n bigint")
    out = lb.vehicle_classes(days.mapInArrow(count, days.schema), 5, 2)
    assert sorted(r["vehicle"] for r in out.collect()) == ["V0", "V1"]
    assert seen.value == 8


def test_a_point_just_outside_its_county_has_not_landed(spark, monkeypatch):
    edge = fx.poly_edges(spark, SF).where("i = 0").orderBy("adcode").first()
    ids = fx.truth(spark, SF).select("sample_id").limit(5)
    outside = ids.select("sample_id", F.lit((edge.x1 + edge.x2) / 2).alias("lng"), F.lit(edge.y1 - 5e-6).alias("lat"))
    monkeypatch.setattr(evaluation.prediction, "selected", lambda *_: outside)
    assert {r["landed"] for r in evaluation.landed(spark, SF).collect()} == {None}


def test_settling_in_blocks_and_rounds_equals_one_step_after_another():
    rng = np.random.default_rng(3)
    sizes = rng.integers(1, 60, 80)
    starts = np.cumsum(sizes) - sizes
    seg = np.repeat(np.arange(80), sizes)
    x, y = rng.integers(0, 40, (2, sizes.sum())) * 50.0 + rng.integers(0, 3, 80)[seg] * 2e5
    w = rng.random(len(x)) ** 4
    w /= np.add.reduceat(w, starts)[seg]
    cx, cy = (np.add.reduceat(w * v, starts) for v in (x, y))
    got = md._settle(x, y, w, starts, cx, cy)
    live = sizes > 1
    for _ in range(md.MAX_ITER):
        nx, ny, done = md._move(md._sums(x, y, w, starts, seg, cx, cy), cx, cy)
        cx, cy = np.where(live, nx, cx), np.where(live, ny, cy)
        live &= ~done
    np.testing.assert_allclose(got, [cx, cy], atol=1e-6)


def test_lists_are_solved_in_bounded_memory():
    table = pa.table({"adcode": [str(i // 10) for i in range(500)], "lng": [100 + i % 10 * 0.001 for i in range(500)],
                      "lat": [30 + i // 10 * 0.2 for i in range(500)]})
    store = md._Store(table)
    lists = pa.array([[{"adcode": str((k + j) % 50), "p": 1.0 / (j + 1)} for j in range(50)] for k in range(4000)])
    tracemalloc.start()
    store.solve(lists, True, md.CHUNK_POINTS)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    # 2 million points; a million of them at once took 190 MB.
    assert peak < 120e6


def test_the_sweep_is_solved_once(spark, monkeypatch):
    seen = spark.sparkContext.accumulator(0)

    def count(batches):
        for batch in batches:
            seen.add(batch.num_rows)
            yield batch

    errors = spark.createDataFrame([(t, k, float(i)) for t in (0.5, 1.0) for k in (1, 3) for i in range(10)], "temperature double, k int, km double")
    monkeypatch.setattr(evaluation, "sweep_errors", lambda *_: errors.mapInArrow(count, errors.schema))
    assert evaluation.sweep_grid(spark, SF).count() == 4
    assert seen.value == 40


def test_priors_are_spread_in_bounded_memory():
    rows = [(str(v), y, [str((v + j) % 200) for j in range(9)]) for v in range(95) for y in ("1995", None)]
    profiles = vh._Profiles(pa.table({"vehicle": [r[0] for r in rows], "year": pa.array([r[1] for r in rows], pa.string()),
                                      "codes": pa.array([r[2] for r in rows])}))
    n, kind = 4000, pa.list_(pa.struct([("k", pa.string()), ("p", pa.float64())]))
    batch = pa.RecordBatch.from_arrays([
        pa.array(range(n)), pa.array([[{"k": str(v), "p": 1 / 95} for v in range(95)]] * n, kind),
        pa.array([[{"k": str(y), "p": 0.2} for y in range(1993, 1998)]] * n, kind)], ["s", "v", "y"])
    tracemalloc.start()
    assert sum(out.num_rows for out in vh._spread(profiles, vh.CELLS)([batch])) == n
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    # The whole batch has 1.9 million entries.
    assert peak < 60e6


def test_shards_without_content_share_files(spark, tmp_path):
    rows = spark.range(300).select(F.format_string("%03d", "id").alias("panoid"), F.lit(10).alias("bytes"), F.floor(F.col("id") / 2).alias("shard"))
    sinks.write_shards(rows, f"{tmp_path}/plain")
    assert len(list((tmp_path / "plain" / "samples").rglob("*.parquet"))) <= 8
    back = spark.read.schema("panoid string, shard bigint").parquet(f"{tmp_path}/plain/samples")
    assert back.exceptAll(rows.select("panoid", "shard")).isEmpty() and back.count() == 300
    sinks.write_shards(rows.withColumn("content", F.lit(b"x")), f"{tmp_path}/full")
    assert len(list((tmp_path / "full" / "samples").glob("shard=*"))) == 150
