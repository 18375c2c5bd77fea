import hashlib
import math
import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from countygeo.functions import scalar as sc
from countygeo.operators import checks as ck
from countygeo.operators import ingest as ig
from countygeo.operators import labels as lb
from countygeo.operators import sampling as sm
from countygeo.operators import splits as sp


def digest(seed, *parts):
    return hashlib.md5("|".join([str(seed), *map(str, parts)]).encode()).hexdigest()


def pool_rows():
    rng = random.Random(11)
    rows = []
    for c, county in enumerate(["510104", "510105", "110101"]):
        for i in range(120):
            pid = f"09{c}069{i % 4:04d}1410{i % 7 + 1:02d}{c}{i:08d}5M"
            rows.append((pid, 100 + rng.uniform(0, 0.02), 30 + rng.uniform(0, 0.02), county))
    return rows


def test_pool_equals_the_greedy_loop(spark):
    rows = pool_rows()
    scan = spark.createDataFrame(rows, "panoid string, lng double, lat double, adcode string")
    got = {r.panoid for r in sm.sample_pool(scan, per_county=6, focus=12, factor=4).collect()}
    want = set()
    for county in {r[3] for r in rows}:
        quota = 12 if county.startswith("51") else 6
        mine = sorted((r for r in rows if r[3] == county), key=lambda r: digest(sc.SEED, r[0]))[:4 * quota]
        mine.sort(key=lambda r: digest(f"{sc.SEED}/thin", r[0]))
        seen, kept = set(), 0
        for pid, lng, lat, _ in mine:
            lng, lat = round(lng, 6), round(lat, 6)
            cell = (int(lng * 111320.0 * math.cos(math.radians(lat)) / 300), int(lat * 111320.0 / 300))
            if cell not in seen:
                seen.add(cell)
                want.add(pid)
                kept += 1
                if kept == quota:
                    break
    assert got == want


def split_rows():
    rng = random.Random(5)
    rows = []
    for c in range(30):
        for i in range(60):
            vehicle = "shared" if i % 10 == 0 else f"v{c}_{i // 4}"
            rows.append((f"f{c:02d}{i:03d}", f"51{c:04d}", "sichuan", vehicle, f"19{rng.randrange(1, 12):02d}01"))
    for i in range(400):
        rows.append((f"n{i:04d}", f"11{i % 40:04d}", "national", f"w{i // 3}", "190101"))
    # One group holds a third of all rows.
    rows += [(f"h{i:05d}", f"31{i % 9:04d}", "national", "hot", "190101") for i in range(1100)]
    return rows


@pytest.fixture(scope="module")
def split_case(spark):
    rows = split_rows()
    samples = spark.createDataFrame(rows, "panoid string, adcode string, part string, vehicle string, date string")
    split = sp.assign_splits(samples, 5, 12, 0.1, 40)
    return rows, samples, split, {r.panoid: r.split for r in split.collect()}


def test_split_equals_the_greedy_loop(spark, split_case):
    rows, samples, _, got = split_case
    by_county, groups = defaultdict(int), defaultdict(list)
    for r in rows:
        by_county[r[1]] += 1
        groups[f"{r[3]}|{r[4]}"].append(r)
    eligible = sorted(a for a, n in by_county.items() if a.startswith("51") and n >= 40)
    holdout = {eligible[int(i * (len(eligible) / 5))] for i in range(5)}
    want = {}
    for gid, members in groups.items():
        if any(m[1] in holdout for m in members):
            want[gid] = "test_county"
    held = defaultdict(int)
    for gid in sorted(groups, key=lambda g: (digest(f"{sc.SEED}/same", g), g)):
        members = groups[gid]
        counties = {m[1] for m in members if m[1].startswith("51")}
        if gid in want or all(m[2] == "national" for m in members) or not counties:
            continue
        if all(held[c] >= 12 for c in counties):
            continue
        want[gid] = "val_same"
        for m in members:
            if m[1] in counties:
                held[m[1]] += 1
    rest = sorted((g for g, m in groups.items() if g not in want and all(x[2] == "national" for x in m)),
                  key=lambda g: digest(f"{sc.SEED}/other", g))
    for gid in rest[:int(len(rest) * 0.1)]:
        want[gid] = "val_national"
    assert got == {m[0]: want.get(g, "train") for g, members in groups.items() for m in members}


def test_split_invariants(split_case):
    rows, samples, split, got = split_case
    assert len(got) == len(rows) and set(got.values()) <= set(sp.SPLITS)
    assert sp.split_leaks(samples, split).isEmpty() and sp.crossing_groups(samples, split).isEmpty()
    report = ck.preflight(samples, split).first()
    assert report.samples == len(rows) and report.duplicate_ids == report.key_differences == report.crossing_groups == 0


def test_too_few_counties_raise(spark):
    samples = spark.createDataFrame([("p", "510101", "sichuan", "v", "d")], "panoid string, adcode string, part string, vehicle string, date string")
    with pytest.raises(Exception, match="fewer than"):
        sp.holdout_counties(sp.group_sizes(samples), 3, 1).collect()


def test_shards_follow_the_running_sum(spark):
    df = spark.range(100).select(F.format_string("%03d", "id").alias("panoid"), (F.col("id") % 7 * 10 + 5).alias("bytes"))
    rows = ig.assign_shards(df, 200).orderBy("panoid").collect()
    before = 0
    for r in rows:
        assert r["shard"] == before // 200
        before += r.bytes
    totals = ig.manifest(ig.assign_shards(df, 200)).agg(F.sum("samples"), F.sum("bytes")).first()
    assert tuple(totals) == (100, before)


def test_no_vehicle_with_enough_rows_raises(spark):
    days = spark.createDataFrame([("V1", "20240101", 3), ("V1", "20240102", 3), ("", "20240101", 90)], "vehicle string, date string, n long")
    assert [r.vehicle for r in lb.vehicle_classes(days, 5, 2).collect()] == ["V1"]
    for rows in (days, days.limit(0)):
        with pytest.raises(ValueError, match="no vehicle has"):
            lb.vehicle_classes(rows, 20, 2)


def test_vehicles_that_nothing_covers(spark):
    classes = spark.createDataFrame([("V1",), ("V2",), ("V3",)], "vehicle string")
    coverage = spark.createDataFrame([("v1",), ("V3",), (None,), ("V9",)], "vehicle string")
    assert [r.vehicle for r in ck.unsupported_vehicles(classes, coverage).collect()] == ["V2"]
