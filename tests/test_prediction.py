import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from countygeo.operators import fusion as fu
from countygeo.operators import labels as lb
from countygeo.operators import losses as ls
from countygeo.operators import ranking
from countygeo.operators import median as md
from countygeo.operators import metrics as mt
from countygeo.operators import reports as rp

CODES = ["510104", "510105", "510107"]
CENTS = [("510104", 0, 104.06, 30.67), ("510105", 1, 104.06, 30.93), ("650100", 2, 87.6, 43.8)]


def fused(spark, env, text=None, **kw):
    df = spark.createDataFrame([(env, text or env)], "env array<double>, text array<double>")
    return fu.fuse(df, "env", "text" if text else None, **kw).first().probs


def test_fusion_algebra(spark):
    assert np.allclose(fused(spark, [0.7, 0.2, 0.1]), [0.7, 0.2, 0.1], atol=1e-9)
    assert fused(spark, [0.5, 0.3, 0.2], [0.6, 0.25, 0.15])[0] > 0.5
    a, b = [0.9, 0.05, 0.05], [0.05, 0.9, 0.05]
    assert int(np.argmax(fused(spark, a, b, w_env=3.0))) == 0
    assert int(np.argmax(fused(spark, a, b, w_text=3.0))) == 1
    out = fused(spark, [1.0, 0.0, 0.0], [0.0, 1.0, 0.0])
    assert out[1] > 0 and abs(sum(out) - 1) < 1e-9
    with pytest.raises(Exception, match="differ in length"):
        fused(spark, [0.5, 0.5], [1.0])


def test_map_input_aligns_to_codes(spark):
    df = spark.createDataFrame([({"510105": 0.5, "999999": 0.5},)], "p map<string,double>")
    row = df.select(fu.map_to_log("p", F.array(*[F.lit(c) for c in CODES])).alias("v")).first().v
    assert np.allclose(row, [math.log(1e-12), math.log(0.5), math.log(1e-12)])


def test_candidates_need_points_before_the_cut(spark):
    cls = spark.createDataFrame([(0, "a", False), (1, "b", True), (2, "c", True)], "class_idx int, adcode string, has_points boolean")
    df = lb.with_classes(spark.createDataFrame([([0.6, 0.3, 0.1],)], "probs array<double>"), cls, "adcode", "has_points")
    got = df.select(fu.usable_candidates("probs", "classes", 1).alias("c")).first().c
    assert [(x.adcode, x.p) for x in got] == [("b", 0.3)]


def cost(c, pts, w):
    a = np.radians(pts)
    b = np.radians(np.asarray(c))
    h = np.sin((a[:, 1] - b[1]) / 2) ** 2 + np.cos(a[:, 1]) * np.cos(b[1]) * np.sin((a[:, 0] - b[0]) / 2) ** 2
    return float((w * 2 * 6371008.8 * np.arcsin(np.sqrt(h))).sum())


CASES = {
    "square": ([(0, 0), (0, 2), (2, 0), (2, 2)], [1, 1, 1, 1]),
    "pair": ([(100.0, 30.0), (100.2, 30.0)], [1, 1]),
    "single": ([(104.5, 30.5)], [1]),
    "dominant": ([(0, 0), (1, 0), (10, 0)], [1, 1, 1000]),
    "onpoint": ([(0, 0), (-1, 0), (1, 0), (0.0, 0.5)], [0.1, 1, 1, 0.1]),
}


def points_frame(spark):
    rows = [(k, float(x), float(y), float(w)) for k, (pts, ws) in CASES.items() for (x, y), w in zip(pts, ws)]
    rng = np.random.default_rng(7)
    for i in range(8):
        for (x, y), w in zip(rng.uniform(0, 1, (25, 2)), rng.uniform(0.1, 1, 25)):
            rows.append((f"r{i}", float(x), float(y), float(w)))
    return rows, spark.createDataFrame(rows, "key string, lng double, lat double, w double")


def test_median_in_tasks(spark):
    rows, df = points_frame(spark)
    got = {r.key: (r.lng, r.lat) for r in md.weighted_median(df, "key").collect()}
    assert np.allclose(got["square"], (1, 1), atol=1e-4) and np.allclose(got["pair"], (100.1, 30), atol=1e-4)
    assert got["single"] == (104.5, 30.5) and abs(got["dominant"][0] - 10) < 1e-2
    for i in range(8):
        mine = [r for r in rows if r[0] == f"r{i}"]
        pts, w = np.array([r[1:3] for r in mine]), np.array([r[3] for r in mine])
        w = w / w.sum()
        grid = min(cost((x, y), pts, w) for x in np.linspace(-0.1, 1.1, 60) for y in np.linspace(-0.1, 1.1, 60))
        assert cost(got[f"r{i}"], pts, w) <= grid + 1e-6


def test_median_is_equal_for_any_lane_size(spark):
    rows, df = points_frame(spark)
    few = df.where(F.col("key").isin("square", "single", "dominant", "r2"))
    want = {r.key: (r.lng, r.lat) for r in md.weighted_median(few, "key").collect()}
    got = {r.key: (r.lng, r.lat) for r in md.weighted_median(few, "key", lane_points=3).collect()}
    assert want.keys() == got.keys() and all(np.allclose(want[k], got[k], atol=1e-6) for k in want)


def test_median_of_repeated_points_and_one_hot_key(spark):
    """A key with most rows, many of them one point, gives what its merged points give."""
    rows = [("hot", 100.0, 30.0, 1.0)] * 300 + [("hot", 100.0 + i / 50, 30.0 + (i * 7 % 11) / 50, 1.0) for i in range(60)] + [("b", 1.0, 2.0, 0.3)] * 5
    df = spark.createDataFrame(rows, "key string, lng double, lat double, w double")
    merged = df.groupBy("key", "lng", "lat").agg(F.sum("w").alias("w"))
    got = {r.key: (r.lng, r.lat) for r in md.weighted_median(df.repartition(5), "key", lane_points=16).collect()}
    want = {r.key: (r.lng, r.lat) for r in md.weighted_median(merged, "key").collect()}
    assert np.allclose(got["b"], (1.0, 2.0)) and np.allclose(got["hot"], want["hot"], atol=1e-3)


def test_median_without_rows_or_keys(spark):
    none = spark.createDataFrame([(None, 1.0, 2.0, 1.0)], "key string, lng double, lat double, w double")
    assert md.weighted_median(none, "key").count() == 0


def test_median_rejects_bad_input(spark):
    for row in [("k", 1.0, 1.0, 0.0), ("k", float("nan"), 1.0, 1.0)]:
        with pytest.raises(Exception):
            md.weighted_median(spark.createDataFrame([row], "key string, lng double, lat double, w double"), "key").collect()


def sweep_case(spark):
    rng = random.Random(2)
    codes = [f"51{i:04d}" for i in range(6)]
    points = [(c, 100 + i * 0.3 + rng.uniform(0, 0.05), 30 + rng.uniform(0, 0.05)) for i, c in enumerate(codes) for _ in range(4)]
    logits = [(k, [rng.uniform(0, 3) for _ in codes], 100.4, 30.1) for k in range(5)]
    cls = spark.createDataFrame([(i, c, i != 2) for i, c in enumerate(codes)], "class_idx int, adcode string, has_points boolean")
    return codes, points, logits, cls


def test_sweep_against_single_medians(spark):
    codes, points, logits, cls = sweep_case(spark)
    table = spark.createDataFrame(points, "adcode string, lng double, lat double")
    df = spark.createDataFrame(logits, "sample_id int, logits array<double>, truth_lng double, truth_lat double")
    got = rp.sweep(df, cls, table, (0.5, 1.0), (1, 3)).collect()
    assert len(got) == 20
    for r in got:
        x = np.array(logits[r.sample_id][1])
        best = [i for i in np.argsort(-x, kind="stable") if i != 2][:r.k]
        p = np.exp((x - x.max()) / r.temperature)
        pts = np.array([q[1:] for i in best for q in points if q[0] == codes[i]])
        w = np.repeat([p[i] / 4 for i in best], 4)
        lng, lat = md._medians(pts[:, 0], pts[:, 1], w, np.array([0]))
        assert np.allclose((r.lng, r.lat), (lng[0], lat[0]), atol=1e-7)


def test_selected_points_equal_medians_and_reject_bad_lists(spark):
    codes, points, logits, cls = sweep_case(spark)
    table = spark.createDataFrame(points, "adcode string, lng double, lat double")
    kind = "sample_id int, candidates array<struct<adcode:string,p:double>>"
    lists = spark.createDataFrame([(1, [(codes[0], 0.7), (codes[1], 0.3)]), (2, [(codes[3], 1.0)])], kind)
    a = {r.sample_id: (r.lng, r.lat) for r in md.select_points(lists, table).collect()}
    joined = {r.sample_id: (r.lng, r.lat) for r in md.select_points(lists, table, store_points=3).collect()}
    assert joined == a and "Exchange" not in md.select_points(lists, table)._jdf.queryExecution().executedPlan().toString()
    flat = lists.select("sample_id", F.explode("candidates").alias("c")).select("sample_id", "c.adcode", "c.p")
    b = {r.sample_id: (r.lng, r.lat) for r in md.weighted_median(fu.candidate_points(flat, table), "sample_id").collect()}
    assert a.keys() == b.keys() == {1, 2} and all(np.allclose(a[k], b[k], atol=1e-7) for k in a)
    spoilt = table.unionAll(spark.createDataFrame([(codes[0], float("nan"), 30.0)], table.schema))
    for bad, places, message in (([], table, "empty candidate list"), ([("990000", 1.0)], table, "no points"),
                                 ([(codes[0], 0.0)], table, "no usable weight"), ([(codes[0], float("nan"))], table, "no usable weight"),
                                 ([(codes[0], 1.0)], spoilt, "bad coordinates")):
        for limit in (3, 1000):
            with pytest.raises(Exception, match=message):
                md.select_points(spark.createDataFrame([(1, bad)], kind), places, store_points=limit).collect()
    bare = spark.createDataFrame([(1, "990000", 1.0)], "sample_id int, adcode string, p double")
    with pytest.raises(Exception, match="no points"):
        fu.candidate_points(bare, table).collect()


def test_rank_of_the_target_counts_all_scores(spark):
    rows = [(k, [0.1, 0.5, 0.5, 0.9, 0.2], k - 1) for k in range(6)]
    df = spark.createDataFrame(rows, "sample_id int, logits array<double>, target int")
    got = df.select("target", mt.target_rank("logits").alias("target_rank"))
    assert [r.target_rank for r in got.orderBy("target").collect()] == [None, 5, 2, 3, 1, 4]
    row = mt.top_k_accuracy(got.where("target >= 0"), [1, 3, 500]).first()
    assert (row.top1, row.top3, row.top500) == (0.2, 0.6, 1.0)


def test_order_statistics_reject_nan(spark):
    df = spark.createDataFrame([(5.0,), (float("nan"),)], "km double")
    with pytest.raises(Exception, match="NaN"):
        ranking.linear_quantiles(df, [], "km", {"m": 0.5}).collect()


def test_pooling_takes_every_view(spark):
    views = spark.createDataFrame([("s", i, True, 0.0, [float(i)]) for i in range(10)],
                                  "sample_id string, view int, mask boolean, score double, vec array<double>")
    assert ls.pool_views(views).first().pooled[0] == pytest.approx(4.5)


def test_majority_predictor_metrics(spark):
    targets = [0] * 5 + [1] * 90 + [2] * 5
    preds = spark.createDataFrame([(i, t, [1, 0, 2]) for i, t in enumerate(targets)], "sample_id int, target int, ranked array<int>")
    cls = spark.createDataFrame(CENTS, "adcode string, class_idx int, lng double, lat double")
    row = mt.summarize(preds, cls).first()
    assert row.top1 == 0.9 and row.top5 == row.top10 == 1.0 and row.majority_baseline == 0.9
    assert abs(row.macro_recall - 1 / 3) < 1e-9 and row.known_fraction == 1.0
    assert mt.near_consistency(preds, cls, k=2).first()[0] == 0.95


@pytest.mark.parametrize("radius", [0.0, 150.0, 3000.0, 30000.0])
def test_near_pairs_equal_all_pairs(spark, radius):
    """Poles, both sides of the antimeridian, repeated and missing centroids, against every pair."""
    rng = np.random.default_rng(3)
    places = [(float(a), float(b)) for a, b in zip(rng.uniform(-180, 180, 60), rng.uniform(-90, 90, 60))]
    places += [(104 + float(a), 30 + float(b)) for a, b in rng.uniform(0, 4, (60, 2))]
    places += [(180.0, 10.0), (-180.0, 10.0), (179.9, 10.0), (-179.9, 10.0), (0.0, 90.0), (77.0, 90.0), (5.0, -89.9), (185.0 - 360, -89.9)]
    places += [places[0], (None, 1.0), (float("nan"), 1.0)]
    cls = spark.createDataFrame([(i, *p) for i, p in enumerate(places)], "class_idx int, lng double, lat double")
    placed = cls.where("lng is not null and not isnan(lng)")
    other = placed.selectExpr("class_idx as o", "lng as o_lng", "lat as o_lat")
    far = mt.geo.haversine_km("lng", "lat", "o_lng", "o_lat")
    want = {(r.class_idx, r.o) for r in placed.crossJoin(other).where(far <= radius).collect()}
    got = [tuple(r) for r in mt.near_pairs(cls, radius).collect()]
    assert len(got) == len(set(got)) and set(got) == want
    lists = {r.target: r.near for r in mt.near_classes(cls, radius).collect()}
    assert len(lists) == len(places) and lists[len(places) - 2] == [] and sum(map(len, lists.values())) == len(want)
    assert mt.near_classes(cls.limit(0)).count() == 0


def test_soft_targets(spark):
    cls = spark.createDataFrame(CENTS, "adcode string, class_idx int, lng double, lat double")
    rows = {r.class_i: r.weights for r in lb.soft_target_rows(cls).collect()}
    for i, w in rows.items():
        assert abs(sum(w) - 1) < 1e-9 and max(w) == w[i]
    km = spark.range(1).select(mt.geo.haversine_km(F.lit(104.06), F.lit(30.67), F.lit(104.06), F.lit(30.93))).first()[0]
    assert abs(rows[0][1] / rows[0][0] - 0.5 ** (km / 50)) < 1e-9


def test_losses_against_numpy(spark):
    x = np.array([[1.0, 2.0, 0.5], [0.1, -1.0, 3.0]])
    df = spark.createDataFrame([(0, 1, x[0].tolist()), (1, 2, x[1].tolist()), (2, -1, [9.0, 9.0, 9.0])],
                               "sample_id int, target int, logits array<double>")
    logp = x - np.log(np.exp(x).sum(1, keepdims=True))
    want = -np.mean([0.95 * logp[i, t] + 0.05 * logp[i].mean() for i, t in enumerate([1, 2])])
    assert abs(ls.head_loss(df, "logits", "target", "l").first().l - want) < 1e-9
    soft = spark.createDataFrame([(i, [1.0 if i == j else 0.0 for j in range(3)]) for i in range(3)], "class_i int, weights array<double>")
    assert abs(ls.county_loss(df, soft, 0.3).first()[0] - want) < 1e-9


def test_pooling_ignores_masked_views(spark):
    rows = [(1, 0, True, 1.0, [1.0, 0.0]), (1, 1, True, 1.0, [0.0, 1.0]), (1, 2, False, 99.0, [50.0, 50.0])]
    out = ls.pool_views(spark.createDataFrame(rows, "sample_id int, view int, mask boolean, score double, vec array<double>")).first()
    assert np.allclose(out.pooled, [0.5, 0.5]) and np.allclose(out.attn, [0.5, 0.5, 0.0])


def test_truth_is_never_a_prediction(spark):
    rows = spark.createDataFrame([(1, 100.0, 30.0)], "sample_id int, lng double, lat double")
    with pytest.raises(ValueError):
        rp.explicit_truth(rows)
    given = spark.createDataFrame([(2, 1.0, 2.0)], "sample_id int, lng double, lat double")
    with pytest.raises(Exception, match="no truth"):
        rp.explicit_truth(rows, given).collect()
