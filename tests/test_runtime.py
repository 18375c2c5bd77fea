import subprocess
import sys
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from countygeo import runtime
from countygeo.operators import checks, ingest, spatial


def test_intermediate_tables_need_a_shared_folder_off_local_mode():
    for master in ("local", "local[4]", "local[*]", "local[2,3]"):
        runtime.require_one_process(master)
    for master in ("local-cluster[2,1,1024]", "spark://host:7077", "yarn", "k8s://host"):
        with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
            runtime.require_one_process(master)


def test_a_table_of_one_row_group_is_dealt_over_the_cores(spark, tmp_path):
    def sizes(df):
        return sorted(r["count"] for r in df.groupBy(F.spark_partition_id()).count().collect())

    small = {"spark.sql.files.maxPartitionBytes": "2000", "spark.sql.files.openCostInBytes": "0"}
    cores = spark.sparkContext.defaultParallelism
    for name, parts in (("one", 1), ("many", 4 * cores)):
        spark.range(0, 8_000, 1, parts).write.parquet(f"{tmp_path}/{name}")
    for k, v in small.items():
        spark.conf.set(k, v)
    try:
        one = spark.read.parquet(f"{tmp_path}/one")
        assert one.rdd.getNumPartitions() > cores and sizes(one) == [8_000]
        dealt = runtime.spread(one, "id")
        assert max(sizes(dealt)) <= 2 * 8_000 / cores
        assert dealt.agg(F.sum("id")).first()[0] == 8_000 * 7_999 // 2
        many = spark.read.parquet(f"{tmp_path}/many")
        assert runtime.spread(many, "id") is many
        assert runtime.spread(one.limit(0).union(many.limit(0)), "id").count() == 0
    finally:
        for k in small:
            spark.conf.unset(k)


def test_fold_keeps_every_column(spark):
    log = spark.createDataFrame([("a", "done", 1, 1, "x"), ("a", "fail", 2, 2, "y")], "key string, state string, updated int, event_id int, error string")
    assert ingest.fold_state(log).first().asDict() == {"key": "a", "state": "fail", "updated": 2, "event_id": 2, "error": "y"}


def test_empty_split_raises(spark):
    samples, split = spark.createDataFrame([("a",)], "panoid string"), spark.createDataFrame([("a", "train")], "panoid string, split string")
    assert checks.split_members(samples, split, "train").count() == 1
    with pytest.raises(ValueError, match="val_same"):
        checks.split_members(samples, split, "val_same")


def test_nearest_site_across_the_antimeridian(spark):
    q = spark.createDataFrame([(1, "g", 179.9, 0.0)], "k int, g string, lng double, lat double")
    sites = spark.createDataFrame([("g", -179.9, 0.0), ("g", 170.0, 0.0)], "g string, lng double, lat double")
    assert spatial.nearest_in_group(q, sites, "k", "g").select(F.round("d_km", 1)).first()[0] == pytest.approx(22.2)


def test_queries_load_without_a_session():
    root = Path(__file__).resolve().parents[1]
    done = subprocess.run([sys.executable, "-c", "from countygeo.plans import registry; registry.load()"], cwd=root, capture_output=True, text=True, timeout=120)
    assert done.returncode == 0, done.stderr
