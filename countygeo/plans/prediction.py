"""Score queries: softmax, fusion, candidates, medians, metrics, losses."""

from __future__ import annotations

from pyspark.sql import functions as F

from countygeo.functions import geo
from countygeo.functions.arrays import softmax
from countygeo.operators import fusion as fu
from countygeo.operators import labels as lb
from countygeo.operators import losses as ls
from countygeo.operators import median as md
from countygeo.operators import metrics as mt
from countygeo.plans import fixtures as fx
from countygeo.plans import labelling
from countygeo.plans.oracle_views import hav
from countygeo.plans.registry import query, r6
from countygeo.runtime import checkpoint

# Fixed value: candidates from which a point is selected.
TOP_K = 20


def probs(spark, sf, temperature=1.0):
    return fu.fuse(fx.scores(spark, sf), "logits", temperature=temperature, from_logits=True)


def preds(spark, sf, k=10):
    """Ranked classes per sample; every 25th truth is unknown."""
    unknown = F.when(F.col("sample_id") % 25 == 0, F.lit(-1)).otherwise(F.col("target"))
    return fx.scores(spark, sf).select(
        "sample_id", unknown.alias("target"), fu.ranked_classes("logits", k).alias("ranked"))


_PREDS = """
SELECT sample_id, CASE WHEN sample_id % 25 = 0 THEN -1 ELSE target END AS target, class_idx, rnk FROM fx_ranked WHERE rnk <= 10"""
_HITS = """
SELECT sample_id, target, max(CASE WHEN class_idx = target AND rnk <= 1 THEN 1 ELSE 0 END) AS h1,
  max(CASE WHEN class_idx = target AND rnk <= 5 THEN 1 ELSE 0 END) AS h5,
  max(CASE WHEN class_idx = target AND rnk <= 10 THEN 1 ELSE 0 END) AS h10 FROM fx_preds GROUP BY sample_id, target"""
_RANK = """
SELECT sample_id, rnk FROM fx_ranked WHERE class_idx = target AND sample_id % 25 <> 0"""
_PV = {"fx_preds": _PREDS, "fx_hits": _HITS}


@query("softmax", "SELECT sample_id, class_idx, round(p, 6) AS p FROM fx_probs")
def softmax_query(spark, sf):
    return probs(spark, sf).select("sample_id", F.posexplode("probs").alias("class_idx", "p")).select(
        "sample_id", "class_idx", r6("p").alias("p"))


_TEXT = """
SELECT sample_id, class_idx, exp(l) / sum(exp(l)) OVER (PARTITION BY sample_id) AS pt FROM (
  SELECT sample_id, class_idx, CAST(embedding[(class_idx * 3 + 50) % 64 + 1] AS DOUBLE) * 8.0::DOUBLE AS l
  FROM fx_targets, (SELECT class_idx FROM fx_classes))"""


def _two_clues(spark, sf):
    e = fx.table(spark, sf, "embeddings").select(F.col("vec_id").alias("sample_id"), "embedding")
    text = F.transform(F.sequence(F.lit(0), F.size("logits") - 1),
                       lambda j: F.get("embedding", (j * 3 + 50) % fx.DIMS).cast("double") * 8.0)
    return fx.scores(spark, sf).join(e, "sample_id").select(
        "sample_id", softmax(F.col("logits")).alias("env"), softmax(text).alias("text"))


@query("fuse_two", """
SELECT sample_id, class_idx, round(e / sum(e) OVER (PARTITION BY sample_id), 6) AS p FROM (
  SELECT sample_id, class_idx, exp(l - max(l) OVER (PARTITION BY sample_id)) AS e FROM (
    SELECT sample_id, class_idx, (1.0 * ln(greatest(p, 1e-12)) + 0.5 * ln(greatest(pt, 1e-12))) / 0.7::DOUBLE AS l
    FROM fx_probs JOIN fx_text USING (sample_id, class_idx)))""", {"fx_text": _TEXT})
def fuse_two(spark, sf):
    out = fu.fuse(_two_clues(spark, sf), "env", "text", 1.0, 0.5, temperature=0.7)
    return out.select("sample_id", F.posexplode("probs").alias("class_idx", "p")).select(
        "sample_id", "class_idx", r6("p").alias("p"))


@query("top_k", "SELECT sample_id, class_idx, rnk::INT AS rank, round(p, 6) AS p FROM fx_probs WHERE rnk <= 5")
def top_k(spark, sf):
    return probs(spark, sf).select("sample_id", F.posexplode(fu.ranked_pairs("probs", 5)).alias("pos", "c")).select(
        "sample_id", F.col("c.idx").alias("class_idx"), (F.col("pos") + 1).alias("rank"), r6("c.score").alias("p"))


@query("ranked_compact", """
SELECT sample_id, string_agg(class_idx::VARCHAR, ',' ORDER BY rnk) AS ranked FROM fx_preds GROUP BY sample_id""", _PV)
def ranked_compact(spark, sf):
    return preds(spark, sf).select("sample_id", F.array_join("ranked", ",").alias("ranked"))


def pointed_classes(spark, sf):
    """Classes with a flag for counties that have points."""
    pts = labelling.points(spark, sf).select("adcode").distinct().withColumn("__has", F.lit(True))
    return fx.classes(spark, sf).join(F.broadcast(pts), "adcode", "left").select(
        "class_idx", "adcode", F.coalesce("__has", F.lit(False)).alias("has_points"))


def candidates(spark, sf, k=TOP_K, temperature=1.0):
    """Top candidates among counties with points, as (adcode, p) lists."""
    rows = lb.with_classes(probs(spark, sf, temperature), pointed_classes(spark, sf), "adcode", "has_points")
    return rows.select("sample_id", fu.usable_candidates("probs", "classes", k).alias("candidates"))


_CAND = f"""
SELECT sample_id, adcode, p FROM (
  SELECT sample_id, adcode, p, row_number() OVER (PARTITION BY sample_id ORDER BY p DESC, class_idx) AS rn
  FROM fx_probs JOIN fx_classes USING (class_idx) WHERE p > 0 AND adcode IN (SELECT adcode FROM fx_points))
WHERE rn <= {TOP_K}"""
_CPTS = """
SELECT sample_id, c.adcode, lng, lat, p / n AS w FROM fx_candidates c
JOIN (SELECT adcode, count(*) AS n FROM fx_points GROUP BY adcode) s ON c.adcode = s.adcode
JOIN fx_points q ON c.adcode = q.adcode"""
_CV = {"fx_candidates": _CAND, "fx_cpts": _CPTS}


def flat_candidates(spark, sf):
    return candidates(spark, sf).select("sample_id", F.explode("candidates").alias("c")).select(
        "sample_id", F.col("c.adcode").alias("adcode"), F.col("c.p").alias("p"))


@query("usable_candidates", "SELECT sample_id, adcode, round(p, 6) AS p FROM fx_candidates", _CV)
def usable_candidates(spark, sf):
    return flat_candidates(spark, sf).withColumn("p", r6("p"))


def weighted_points(spark, sf):
    return fu.candidate_points(flat_candidates(spark, sf), labelling.points(spark, sf))


@query("candidate_points", """
SELECT sample_id, adcode, round(lng, 6) AS lng, round(lat, 6) AS lat, round(w, 6) AS w FROM fx_cpts""", _CV)
def candidate_points(spark, sf):
    return weighted_points(spark, sf).select(
        "sample_id", "adcode", r6("lng").alias("lng"), r6("lat").alias("lat"), r6("w").alias("w"))


# The iteration as a recursive query: every step recomputes the centre of all
# samples that still move.
MEDIAN_VIEWS = {
    **_CV,
    "fx_mstat": "SELECT sample_id, avg(lng) AS lng0, avg(lat) AS lat0, sum(w) AS t, count(*) AS n FROM fx_cpts GROUP BY sample_id",
    "fx_mplane": """
SELECT sample_id, n, lng, lat, (lng - lng0) * radians(1.0) * 6371008.8 * cos(radians(lat0)) AS x,
       (lat - lat0) * radians(1.0) * 6371008.8 AS y, w / t AS w FROM fx_cpts JOIN fx_mstat USING (sample_id)""",
    "fx_miter": """
SELECT sample_id, sum(w * x) AS cx, sum(w * y) AS cy, 0 AS it, max(n) > 1 AS live FROM fx_mplane GROUP BY sample_id
UNION ALL
SELECT sample_id, CASE WHEN stuck THEN cx ELSE nx END, CASE WHEN stuck THEN cy ELSE ny END, it + 1,
  NOT stuck AND sqrt((nx - cx) * (nx - cx) + (ny - cy) * (ny - cy)) > 1e-7 * greatest(1.0, sqrt(nx * nx + ny * ny))
FROM (
  SELECT *, (1 - pull) * sx / nullif(mass, 0) + pull * cx AS nx, (1 - pull) * sy / nullif(mass, 0) + pull * cy AS ny,
    coalesce(mass, 0) = 0 OR (hm > 0 AND res <= hm) AS stuck
  FROM (
    SELECT sample_id, cx, cy, it, mass, sx, sy, hm, sqrt(rx * rx + ry * ry) AS res,
      CASE WHEN hm > 0 AND sqrt(rx * rx + ry * ry) > 0 THEN hm / sqrt(rx * rx + ry * ry) ELSE 0.0 END AS pull
    FROM (
      SELECT sample_id, cx, cy, it, sum(inv) AS mass, sum(inv * x) AS sx, sum(inv * y) AS sy, sum(inv * (x - cx)) AS rx,
             sum(inv * (y - cy)) AS ry, coalesce(sum(hw), 0) AS hm
      FROM (SELECT m.sample_id, cx, cy, it, x, y,
              CASE WHEN sqrt((x - cx) * (x - cx) + (y - cy) * (y - cy)) >= 0.5 THEN w / sqrt((x - cx) * (x - cx) + (y - cy) * (y - cy)) END AS inv,
              CASE WHEN sqrt((x - cx) * (x - cx) + (y - cy) * (y - cy)) < 0.5 THEN w END AS hw
            FROM fx_miter m JOIN fx_mplane p ON m.sample_id = p.sample_id WHERE m.live AND it < 500)
      GROUP BY sample_id, cx, cy, it)))""",
    "fx_median": """
SELECT sample_id, CASE WHEN n = 1 THEN lng0 ELSE lng0 + cx / (radians(1.0) * 6371008.8 * cos(radians(lat0))) END AS lng,
       CASE WHEN n = 1 THEN lat0 ELSE lat0 + cy / (radians(1.0) * 6371008.8) END AS lat
FROM (SELECT sample_id, arg_max(cx, it) AS cx, arg_max(cy, it) AS cy FROM fx_miter GROUP BY sample_id)
JOIN fx_mstat USING (sample_id)""",
}


@query("weighted_median", "SELECT sample_id, round(lng, 5) AS lng, round(lat, 5) AS lat FROM fx_median", MEDIAN_VIEWS)
def weighted_median(spark, sf):
    out = md.weighted_median(checkpoint(weighted_points(spark, sf)), "sample_id")
    return out.select("sample_id", F.round("lng", 5).alias("lng"), F.round("lat", 5).alias("lat"))


def selected(spark, sf):
    return md.select_points(candidates(spark, sf), labelling.points(spark, sf))


@query("select_point", "SELECT sample_id, round(lng, 5) AS lng, round(lat, 5) AS lat FROM fx_median", MEDIAN_VIEWS)
def select_point(spark, sf):
    return selected(spark, sf).select("sample_id", F.round("lng", 5).alias("lng"), F.round("lat", 5).alias("lat"))


@query("expected_distance", f"""
SELECT sample_id, round(sum(w * {hav('a', 'b', 'lng', 'lat')}), 3) AS expected_m FROM fx_cpts
JOIN (SELECT sample_id, avg(lng) AS a, avg(lat) AS b FROM fx_cpts GROUP BY sample_id) USING (sample_id)
GROUP BY sample_id""", _CV)
def expected_distance(spark, sf):
    pts = weighted_points(spark, sf)
    centers = pts.groupBy("sample_id").agg(F.avg("lng").alias("lng"), F.avg("lat").alias("lat"))
    return md.expected_distance(centers, pts, "sample_id").withColumn("expected_m", F.round("expected_m", 3))


# --------------------------------------------------------------------------
# Metrics
# --------------------------------------------------------------------------

@query("topk_accuracy", """
SELECT round(avg((rnk <= 1)::INT), 6) AS top1, round(avg((rnk <= 5)::INT), 6) AS top5, round(avg((rnk <= 10)::INT), 6) AS top10,
  round(avg((rnk <= 50)::INT), 6) AS top50, round(avg((rnk <= 500)::INT), 6) AS top500 FROM fx_rank""", {"fx_rank": _RANK})
def topk_accuracy(spark, sf):
    known = scored(spark, sf).where(F.col("target") >= 0)
    out = mt.top_k_accuracy(known.select(mt.target_rank("logits").alias("target_rank")), [1, 5, 10, 50, 500])
    return out.select(*[r6(c).alias(c) for c in out.columns])


@query("class_recall", """
SELECT class_idx, round(recall, 6) AS recall FROM fx_classes
LEFT JOIN (SELECT target, avg(h1) AS recall FROM fx_hits WHERE target >= 0 GROUP BY target) ON class_idx = target""", _PV)
def class_recall(spark, sf):
    return mt.class_recall_full(preds(spark, sf), fx.classes(spark, sf)).withColumn("recall", r6("recall"))


@query("macro_recall", """
SELECT round(avg(r), 6) AS macro_recall FROM (SELECT avg(h1) AS r FROM fx_hits WHERE target >= 0 GROUP BY target)""", _PV)
def macro_recall(spark, sf):
    return mt.macro_recall(preds(spark, sf)).select(r6("macro_recall").alias("macro_recall"))


@query("majority_baseline", """
SELECT round(max(n) / sum(n), 6) AS majority_baseline
FROM (SELECT count(*)::DOUBLE AS n FROM fx_hits WHERE target >= 0 GROUP BY target)""", _PV)
def majority_baseline(spark, sf):
    return mt.majority_baseline(preds(spark, sf)).select(r6("majority_baseline").alias("majority_baseline"))


_NEAR = f"""
SELECT p.sample_id, max(CASE WHEN {hav('t.lng', 't.lat', 'c.lng', 'c.lat')} / 1000.0 <= 150.0 THEN 1 ELSE 0 END) AS near
FROM fx_preds p JOIN fx_classes t ON p.target = t.class_idx JOIN fx_classes c ON p.class_idx = c.class_idx
WHERE rnk <= 5 GROUP BY p.sample_id"""


@query("near_consistency", "SELECT round(avg(near), 6) AS near_consistency FROM fx_near", {**_PV, "fx_near": _NEAR})
def near_consistency(spark, sf):
    return mt.near_consistency(preds(spark, sf), fx.classes(spark, sf)).select(
        r6("near_consistency").alias("near_consistency"))


@query("metric_summary", """
SELECT part, round(sum(h1) / sum(c), 6) AS top1, round(sum(h5) / sum(c), 6) AS top5, round(sum(h10) / sum(c), 6) AS top10,
  round(avg(h1 / c), 6) AS macro_recall, round(max(c) / sum(c), 6) AS majority_baseline, sum(c)::BIGINT AS n,
  round(sum(near) / sum(c), 6) AS top5_nearby_150km, round(sum(c) / max(total), 6) AS known_fraction,
  round(sum(h1) / max(total), 6) AS all_top1, round(sum(h5) / max(total), 6) AS all_top5
FROM (SELECT sample_id % 2 = 0 AS part, target, count(*)::DOUBLE AS c, sum(h1) AS h1, sum(h5) AS h5, sum(h10) AS h10, sum(near) AS near
      FROM fx_hits JOIN fx_near USING (sample_id) WHERE target >= 0 GROUP BY 1, 2)
JOIN (SELECT sample_id % 2 = 0 AS part, count(*)::DOUBLE AS total FROM fx_hits GROUP BY 1) USING (part) GROUP BY part""",
       {**_PV, "fx_near": _NEAR})
def metric_summary(spark, sf):
    rows = preds(spark, sf).withColumn("part", F.col("sample_id") % 2 == 0)
    out = mt.summarize(rows, fx.classes(spark, sf), ["part"])
    return out.select(*[r6(c).alias(c) if t == "double" else F.col(c) for c, t in out.dtypes])


@query("known_fraction", """
SELECT round(sum(h1) FILTER (target >= 0) / count(*) FILTER (target >= 0), 6) AS top1,
  round(count(*) FILTER (target >= 0)::DOUBLE / count(*), 6) AS known_fraction,
  round(sum(h1) FILTER (target >= 0) / count(*)::DOUBLE, 6) AS all_top1,
  round(sum(h5) FILTER (target >= 0) / count(*)::DOUBLE, 6) AS all_top5, count(*) FILTER (target >= 0) AS n FROM fx_hits""", _PV)
def known_fraction(spark, sf):
    out = mt.summarize(preds(spark, sf))
    return out.select(*[r6(c).alias(c) for c in ("top1", "known_fraction", "all_top1", "all_top5")], "n")


@query("aux_accuracy", """
SELECT round(count(*) FILTER (y >= 0 AND y = yp)::DOUBLE / greatest(1, count(*) FILTER (y >= 0)), 6) AS city_or_year_top1,
  round(count(*) FILTER (z >= 0 AND z = zp)::DOUBLE / greatest(1, count(*) FILTER (z >= 0)), 6) AS province_or_prefix_top1
FROM (SELECT CASE WHEN target >= 0 THEN target // 8 ELSE -1 END AS y, class_idx // 8 AS yp,
             CASE WHEN target >= 0 THEN target // 40 ELSE -1 END AS z, class_idx // 40 AS zp FROM fx_preds WHERE rnk = 1)""", _PV)
def aux_accuracy(spark, sf):
    best = F.get("ranked", F.lit(0))
    known = F.col("target") >= 0
    rows = preds(spark, sf).select(
        F.when(known, F.floor(F.col("target") / 8)).otherwise(-1).alias("y"), F.floor(best / 8).alias("yp"),
        F.when(known, F.floor(F.col("target") / 40)).otherwise(-1).alias("z"), F.floor(best / 40).alias("zp"))
    out = mt.auxiliary_accuracy(rows, {"city_or_year_top1": ("yp", "y"), "province_or_prefix_top1": ("zp", "z")})
    return out.select(*[r6(c).alias(c) for c in out.columns])


def centroid_rows(spark, sf):
    """Best class's centroid against the truth."""
    t = fx.truth(spark, sf).select("sample_id", "truth_lng", "truth_lat")
    return mt.centroid_error(preds(spark, sf).join(t, "sample_id"), fx.classes(spark, sf))


CENTROID_VIEW = {"fx_preds": _PREDS, "fx_cerr": f"""
SELECT p.sample_id, {hav('c.lng', 'c.lat', 't.truth_lng', 't.truth_lat')} / 1000.0 AS km
FROM fx_preds p JOIN fx_classes c ON p.class_idx = c.class_idx JOIN fx_truth t ON p.sample_id = t.sample_id WHERE rnk = 1"""}


@query("centroid_error", "SELECT sample_id, round(km, 6) AS km FROM fx_cerr", CENTROID_VIEW)
def centroid_error(spark, sf):
    return centroid_rows(spark, sf).select("sample_id", r6("km").alias("km"))


@query("distance_summary", """
SELECT round(quantile_cont(km, 0.5), 6) AS median_km, round(avg(km), 6) AS mean_km, round(quantile_cont(km, 0.25), 6) AS p25_km,
  round(quantile_cont(km, 0.75), 6) AS p75_km, round(avg((km <= 25)::INT), 6) AS within_25km,
  round(avg((km <= 100)::INT), 6) AS within_100km FROM fx_cerr""", CENTROID_VIEW)
def distance_summary(spark, sf):
    out = mt.distance_summary(centroid_rows(spark, sf))
    return out.select(*[r6(c).alias(c) for c in out.columns])


@query("geo_score", "SELECT round(avg(5000.0 * exp(-km / 150.0)), 6) AS geo_score FROM fx_cerr", CENTROID_VIEW)
def geo_score(spark, sf):
    return mt.mean_game_score(centroid_rows(spark, sf)).select(r6("geo_score").alias("geo_score"))


# --------------------------------------------------------------------------
# Losses
# --------------------------------------------------------------------------

_LOGP = """
SELECT sample_id, CASE WHEN sample_id % 25 = 0 THEN -1 ELSE target END AS target, class_idx,
  logit - max(logit) OVER w - ln(sum(exp(logit - m)) OVER w) AS lp
FROM (SELECT *, max(logit) OVER (PARTITION BY sample_id) AS m FROM fx_scores) WINDOW w AS (PARTITION BY sample_id)"""
_SOFT_LOSS = """
SELECT sample_id, target, -sum((0.95 * (0.8 * w + 0.2 * (class_idx = target)::INT) + 0.05 / (SELECT count(*) FROM fx_classes)) * lp) AS l
FROM fx_logp JOIN fx_soft ON target = class_i AND class_idx = class_j GROUP BY sample_id, target"""
_LV = {"fx_logp": _LOGP, "fx_softloss": _SOFT_LOSS}


def scored(spark, sf):
    unknown = F.when(F.col("sample_id") % 25 == 0, F.lit(-1)).otherwise(F.col("target"))
    return fx.scores(spark, sf).withColumn("target", unknown)


@query("soft_ce", "SELECT round(avg(l), 5) AS county_loss FROM fx_softloss", _LV)
def soft_ce(spark, sf):
    soft = lb.soft_target_rows(fx.classes(spark, sf))
    return ls.county_loss(scored(spark, sf), soft, 0.8).select(F.round("county_loss", 5).alias("county_loss"))


@query("hard_ce", """
SELECT round(avg(l), 5) AS city_loss FROM (
  SELECT sample_id, -(0.95 * sum(lp) FILTER (class_idx = target) + 0.05 * avg(lp)) AS l
  FROM fx_logp WHERE target >= 0 GROUP BY sample_id)""", _LV)
def hard_ce(spark, sf):
    return ls.head_loss(scored(spark, sf), "logits", "target", "city_loss").select(F.round("city_loss", 5).alias("city_loss"))


@query("view_ce", """
SELECT round(avg(l), 5) AS view_loss FROM (
  SELECT sample_id // 4 AS g, sum(CASE WHEN sample_id % 4 < 3 THEN l ELSE 0 END) / greatest(1, count(*) FILTER (sample_id % 4 < 3)) AS l
  FROM fx_softloss GROUP BY 1)""", _LV)
def view_ce(spark, sf):
    views = scored(spark, sf).select(F.floor(F.col("sample_id") / 4).alias("sample_id"), "target", "logits",
                                     (F.col("sample_id") % 4 < 3).alias("mask"))
    soft = lb.soft_target_rows(fx.classes(spark, sf))
    return ls.view_loss(views, soft, 0.8).select(F.round("view_loss", 5).alias("view_loss"))


_L1 = """
SELECT avg((CASE WHEN a < 1 THEN 0.5 * a * a ELSE a - 0.5 END + CASE WHEN b < 1 THEN 0.5 * b * b ELSE b - 0.5 END) / 2) AS l FROM (
  SELECT abs(CAST(embedding[1] AS DOUBLE) * 5.0 - (truth_lng - 73.0) / 62.0) AS a,
         abs(CAST(embedding[2] AS DOUBLE) * 5.0 - (truth_lat - 18.0) / 36.0) AS b
  FROM fx_truth t JOIN embeddings e ON t.sample_id = e.vec_id)"""


def _coords(spark, sf):
    e = fx.table(spark, sf, "embeddings").select(
        F.col("vec_id").alias("sample_id"), (F.get("embedding", F.lit(0)).cast("double") * 5.0).alias("px"),
        (F.get("embedding", F.lit(1)).cast("double") * 5.0).alias("py"))
    return fx.truth(spark, sf).join(e, "sample_id").select(
        "px", "py", geo.normalize_lng("truth_lng").alias("tx"), geo.normalize_lat("truth_lat").alias("ty"))


@query("smooth_l1", "SELECT round(l, 6) AS coord_loss FROM fx_l1", {"fx_l1": _L1})
def smooth_l1(spark, sf):
    return ls.smooth_l1(_coords(spark, sf), [("px", "tx"), ("py", "ty")]).select(r6("coord_loss").alias("coord_loss"))


@query("total_loss", """
SELECT round(county + 0.3 * hard + 0.2 * hard + 0.1 * coord, 4) AS total_loss FROM
  (SELECT avg(l) AS county FROM fx_softloss),
  (SELECT avg(l) AS hard FROM (SELECT sample_id, -(0.95 * sum(lp) FILTER (class_idx = target) + 0.05 * avg(lp)) AS l
                               FROM fx_logp WHERE target >= 0 GROUP BY sample_id)),
  (SELECT l AS coord FROM fx_l1)""", {**_LV, "fx_l1": _L1})
def total_loss(spark, sf):
    rows = scored(spark, sf)
    soft = lb.soft_target_rows(fx.classes(spark, sf))
    county = ls.county_loss(rows, soft, 0.8).scalar()
    hard = ls.head_loss(rows, "logits", "target", "l").scalar()
    parts = ls.smooth_l1(_coords(spark, sf), [("px", "tx"), ("py", "ty")]).withColumns({
        "county_loss": county, "city_loss": hard, "prov_loss": hard, "view_loss": F.lit(0.0)})
    return ls.total_loss(parts).select(F.round("total_loss", 4).alias("total_loss"))


@query("pool_views", """
SELECT sample_id, dim, round(sum(a * v), 5) AS value FROM (
  SELECT vec_id // 8 AS sample_id, vec_id % 8 AS view, unnest(range(64)) AS dim, unnest(embedding)::DOUBLE AS v FROM embeddings)
JOIN (
  SELECT sample_id, view, CASE WHEN mask THEN e ELSE 0 END / greatest(sum(CASE WHEN mask THEN e ELSE 0 END) OVER (PARTITION BY sample_id), 1e-6) AS a
  FROM (SELECT *, exp(s - max(s) OVER (PARTITION BY sample_id)) AS e FROM (
    SELECT vec_id // 8 AS sample_id, vec_id % 8 AS view, vec_id % 8 <= (vec_id // 8) % 8 AS mask,
           CASE WHEN vec_id % 8 <= (vec_id // 8) % 8 THEN CAST(embedding[41] AS DOUBLE) * 10 ELSE -1e4 END AS s FROM embeddings)))
USING (sample_id, view) GROUP BY sample_id, dim""")
def pool_views(spark, sf):
    k = F.col("vec_id")
    sample = F.floor(k / 8)
    views = fx.table(spark, sf, "embeddings").select(
        sample.alias("sample_id"), (k % 8).alias("view"), (k % 8 <= sample % 8).alias("mask"),
        (F.get("embedding", F.lit(40)).cast("double") * 10).alias("score"), "embedding").withColumn(
        "vec", F.transform("embedding", lambda v: v.cast("double")))
    return ls.pool_views(views.select("sample_id", "view", "mask", "score", "vec")).select(
        "sample_id", F.posexplode("pooled").alias("dim", "value")).select(
        "sample_id", F.col("dim").cast("bigint").alias("dim"), F.round("value", 5).alias("value"))
