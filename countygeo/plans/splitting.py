"""Split, integrity and ingest queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from countygeo.functions import scalar as sc
from countygeo.operators import checks as ck
from countygeo.operators import ingest as ig
from countygeo.operators import splits as sp
from countygeo.plans import collect
from countygeo.plans import fixtures as fx
from countygeo.plans.oracle_views import digest
from countygeo.plans.registry import query, r6

# Parameters small enough to bind at the test scales.
SPLIT = {"holdout_n": 5, "per_county": 3, "other_ratio": 0.1, "min_samples": 5}


def split(spark, sf):
    return sp.assign_splits(fx.samples(spark, sf), **SPLIT)


def holdout(spark, sf):
    return sp.holdout_counties(sp.group_sizes(fx.samples(spark, sf)), SPLIT["holdout_n"], SPLIT["min_samples"])


@query("holdout_counties", "SELECT adcode FROM fx_holdout")
def holdout_counties(spark, sf):
    return holdout(spark, sf)


@query("split_assign", "SELECT panoid, split FROM fx_split")
def split_assign(spark, sf):
    return split(spark, sf)


@query("split_counts", "SELECT split, count(*) AS n FROM fx_split GROUP BY split")
def split_counts(spark, sf):
    return sp.split_counts(split(spark, sf))


@query("test_counties", "SELECT DISTINCT adcode FROM fx_samples JOIN fx_split USING (panoid) WHERE split = 'test_county'")
def test_counties(spark, sf):
    return sp.test_counties(fx.samples(spark, sf), split(spark, sf))


def _row_split(spark, sf):
    """Row-wise split without grouping, which leaks on purpose."""
    draw = F.substring(sc.shuffle_key("leak", "panoid"), 1, 1)
    return fx.samples(spark, sf).select("panoid", F.when(draw == "0", "val_same").when(draw == "1", "test_county")
                                        .otherwise("train").alias("split"))


_ROW_SPLIT = f"""
SELECT panoid, CASE substr({digest('leak', 'panoid')}, 1, 1) WHEN '0' THEN 'val_same' WHEN '1' THEN 'test_county'
  ELSE 'train' END AS split FROM fx_samples"""


@query("split_leaks", """
SELECT gid FROM fx_samples JOIN fx_row_split USING (panoid) GROUP BY gid
HAVING bool_or(split = 'train') AND count(DISTINCT split) > 1""", {"fx_row_split": _ROW_SPLIT})
def split_leaks(spark, sf):
    return sp.split_leaks(fx.samples(spark, sf), _row_split(spark, sf))


@query("crossing_groups", """
SELECT upper(vehicle) AS vehicle, date FROM fx_samples JOIN fx_row_split USING (panoid) GROUP BY 1, 2
HAVING count(DISTINCT split) > 1""", {"fx_row_split": _ROW_SPLIT})
def crossing_groups(spark, sf):
    return sp.crossing_groups(fx.samples(spark, sf), _row_split(spark, sf))


@query("preflight", """
SELECT count(*) AS samples, count(*) FILTER (split = 'train') AS train, count(*) FILTER (split = 'val_same') AS val_same,
  count(*) FILTER (split = 'val_national') AS val_national, count(*) FILTER (split = 'test_county') AS test_county,
  (SELECT count(DISTINCT adcode) FROM fx_train) AS train_counties,
  count(DISTINCT adcode) - (SELECT count(DISTINCT adcode) FROM fx_train) AS untrained_counties,
  (SELECT count(*) FROM (SELECT adcode FROM fx_train GROUP BY adcode HAVING count(*) < 10)) AS train_counties_under_10,
  (SELECT count(*) FROM (SELECT panoid FROM fx_samples GROUP BY 1 HAVING count(*) > 1)) AS duplicate_ids,
  (SELECT count(*) FROM fx_samples a FULL OUTER JOIN fx_split b ON a.panoid = b.panoid
   WHERE a.panoid IS NULL OR b.panoid IS NULL) AS key_differences,
  (SELECT count(*) FROM (SELECT 1 FROM fx_samples JOIN fx_split USING (panoid) WHERE vehicle <> '' AND date <> ''
   GROUP BY upper(vehicle), date HAVING count(DISTINCT split) > 1)) AS crossing_groups,
  (SELECT string_agg(adcode, ',' ORDER BY adcode) FROM (SELECT adcode FROM fx_samples EXCEPT SELECT adcode FROM fx_train)) AS untrained,
  count(*) FILTER (width <> 2 * height) AS not_two_to_one,
  (SELECT count(*) FROM fx_samples WHERE panoid NOT IN (SELECT panoid FROM fx_kept)) AS missing_images,
  (SELECT count(*) FROM (SELECT panoid FROM fx_kept GROUP BY 1 HAVING count(*) > 1)) AS duplicate_images
FROM fx_samples JOIN fx_split USING (panoid)""")
def preflight(spark, sf):
    images = collect.kept_scan(spark, sf).select("panoid")
    return ck.preflight(fx.samples(spark, sf), split(spark, sf), images).withColumn("untrained", F.array_join("untrained", ","))


_BROKEN = {"fx_row_split": _ROW_SPLIT, "fx_broken": "SELECT * FROM fx_row_split WHERE panoid NOT LIKE '%7_'"}


@query("preflight_broken", """
SELECT (SELECT count(*) FROM (SELECT panoid FROM fx_twice GROUP BY 1 HAVING count(*) > 1)) AS duplicate_ids,
  (SELECT count(*) FROM fx_samples WHERE panoid NOT IN (SELECT panoid FROM fx_broken)) AS key_differences,
  (SELECT count(*) FROM (SELECT 1 FROM fx_samples JOIN fx_broken USING (panoid) WHERE vehicle <> '' AND date <> ''
   GROUP BY upper(vehicle), date HAVING count(DISTINCT split) > 1)) AS crossing_groups,
  (SELECT count(*) FROM fx_twice WHERE width <> 2 * height) AS not_two_to_one""", {
    **_BROKEN, "fx_twice": """
SELECT panoid, width, height FROM fx_samples UNION ALL
SELECT panoid, height, width FROM fx_samples WHERE panoid LIKE '%3_'"""})
def preflight_broken(spark, sf):
    """Problem counts over samples with repeats and turned sizes, and a leaky split that misses some."""
    s = fx.samples(spark, sf)
    turned = s.where(F.col("panoid").like("%3_")).withColumns({"width": F.col("height"), "height": F.col("width")})
    broken = _row_split(spark, sf).where(~F.col("panoid").like("%7_"))
    return ck.preflight(s.unionByName(turned), broken).select(
        "duplicate_ids", "key_differences", "crossing_groups", "not_two_to_one")


@query("duplicate_ids", "SELECT o_custkey AS key, count(*) AS n FROM orders GROUP BY 1 HAVING count(*) > 1")
def duplicate_ids(spark, sf):
    return ck.duplicates(fx.table(spark, sf, "orders").select(F.col("o_custkey").alias("key")), "key")


@query("key_differences", """
SELECT coalesce(a.panoid, b.panoid) AS panoid, CASE WHEN b.panoid IS NULL THEN 'left only' ELSE 'right only' END AS side
FROM fx_samples a FULL OUTER JOIN fx_scan b ON a.panoid = b.panoid WHERE a.panoid IS NULL OR b.panoid IS NULL""")
def key_differences(spark, sf):
    return ck.key_differences(fx.samples(spark, sf), collect.sm.scan_panos(fx.panos(spark, sf)), "panoid")


@query("missing_images", "SELECT panoid FROM fx_samples EXCEPT SELECT panoid FROM fx_pool")
def missing_images(spark, sf):
    return ck.missing_keys(fx.samples(spark, sf), collect.pool(spark, sf), "panoid")


@query("cached_keys", "SELECT panoid FROM fx_samples INTERSECT SELECT panoid FROM fx_pool")
def cached_keys(spark, sf):
    return ck.cached_keys(fx.samples(spark, sf), collect.pool(spark, sf), "panoid")


@query("untrained_counties", """
SELECT adcode, adcode IN (SELECT adcode FROM fx_holdout) AS intended
FROM (SELECT adcode FROM fx_samples EXCEPT SELECT adcode FROM fx_train)""")
def untrained_counties(spark, sf):
    return ck.untrained_counties(fx.samples(spark, sf), split(spark, sf), holdout(spark, sf))


@query("class_profile", """
SELECT count(*) AS counties, count(*) FILTER (n >= 100) AS at_least_100, count(*) FILTER (n < 10) AS under_10
FROM (SELECT adcode, count(*) AS n FROM fx_train GROUP BY adcode)""")
def class_profile(spark, sf):
    return ck.class_profile(fx.samples(spark, sf), split(spark, sf))


@query("split_members", "SELECT panoid, adcode FROM fx_samples JOIN fx_split USING (panoid) WHERE split = 'val_same'")
def split_members(spark, sf):
    """Members of a split, which is empty where every focus group touches a held-out county."""
    return ck.split_members(fx.samples(spark, sf), split(spark, sf), "val_same", required=False).select("panoid", "adcode")


def done_rows(spark, sf):
    """Finished rows of the ingest state, more than this round's pool."""
    return fx.samples(spark, sf).select("panoid", "adcode", "part", "bytes", "width", "height", "date")


@query("pool_semi", "SELECT panoid, adcode, bytes FROM fx_samples WHERE panoid IN (SELECT panoid FROM fx_pool)")
def pool_semi(spark, sf):
    return ig.in_pool(done_rows(spark, sf), collect.pool(spark, sf)).select("panoid", "adcode", "bytes")


@query("pool_anti", "SELECT panoid, adcode, bytes FROM fx_samples WHERE panoid NOT IN (SELECT panoid FROM fx_pool)")
def pool_anti(spark, sf):
    return ig.not_in_pool(done_rows(spark, sf), collect.pool(spark, sf)).select("panoid", "adcode", "bytes")


@query("pool_attach", """
SELECT s.panoid, s.adcode, s.bytes, round(p.lng, 6) AS lng, round(p.lat, 6) AS lat, p.vehicle, p.city
FROM fx_samples s LEFT JOIN fx_pool p ON s.panoid = p.panoid""")
def pool_attach(spark, sf):
    out = ig.attach_pool(done_rows(spark, sf), collect.pool(spark, sf))
    return out.select("panoid", "adcode", "bytes", r6("lng").alias("lng"), r6("lat").alias("lat"), "vehicle", "city")


@query("insert_ignore", """
SELECT panoid, adcode, part, 'done' AS state FROM fx_samples
UNION ALL
SELECT panoid, adcode, CASE WHEN adcode LIKE '51%' THEN 'sichuan' ELSE 'national' END, 'pending_meta' FROM fx_panos
WHERE adcode LIKE '51%' AND panoid NOT IN (SELECT panoid FROM fx_samples)""")
def insert_ignore(spark, sf):
    state = fx.samples(spark, sf).select("panoid", "adcode", "part", F.lit("done").alias("state"),
                                         F.lit(None).cast("timestamp").alias("updated"))
    pool = fx.panos(spark, sf).select("panoid", "adcode", sc.part_of("adcode").alias("part"))
    return ig.insert_new(state, pool, part="sichuan").drop("updated")


@query("pending_phase", """
SELECT panoid, adcode, bytes FROM fx_samples WHERE part = 'sichuan' AND bytes % 3 = 0 ORDER BY panoid LIMIT 200""")
def pending_phase(spark, sf):
    state = done_rows(spark, sf).withColumn("state", F.when(F.col("bytes") % 3 == 0, "meta_ok").otherwise("done"))
    return ig.pending(state, "meta_ok", "sichuan", 200).select("panoid", "adcode", "bytes")


_SHARDS = """
SELECT panoid, bytes, CAST(floor(coalesce(sum(bytes) OVER (ORDER BY panoid ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)
  / 50000000.0::DOUBLE) AS BIGINT) AS shard FROM fx_samples"""


@query("shard_assign", "SELECT panoid, shard FROM fx_shards", {"fx_shards": _SHARDS})
def shard_assign(spark, sf):
    return ig.assign_shards(done_rows(spark, sf), 50_000_000).select("panoid", "shard")


@query("manifest", "SELECT shard, count(*) AS samples, sum(bytes)::BIGINT AS bytes FROM fx_shards GROUP BY shard",
       {"fx_shards": _SHARDS})
def manifest(spark, sf):
    return ig.manifest(ig.assign_shards(done_rows(spark, sf), 50_000_000))


def _state(spark, sf):
    k = F.col("bytes") % 5
    return done_rows(spark, sf).withColumns({
        "state": F.when(k == 0, "pending_meta").when(k == 1, "meta_ok").when(k == 2, "fail").otherwise("done"),
        "tile_z": F.when(F.col("part") == "sichuan", 3).otherwise(2)})


_STATE = """
SELECT *, CASE bytes % 5 WHEN 0 THEN 'pending_meta' WHEN 1 THEN 'meta_ok' WHEN 2 THEN 'fail' ELSE 'done' END AS state,
  CASE part WHEN 'sichuan' THEN 3 ELSE 2 END AS tile_z FROM fx_samples"""


@query("state_report", """
SELECT 'state' AS kind, state AS name, count(*) AS n, -1::BIGINT AS bytes, -1::DOUBLE AS width, -1::DOUBLE AS height
FROM fx_st GROUP BY state
UNION ALL
SELECT 'part', part, count(*), sum(bytes)::BIGINT, avg(width), avg(height) FROM fx_st WHERE state = 'done' GROUP BY part
UNION ALL
SELECT 'level', tile_z::VARCHAR, count(*), -1, -1, -1 FROM fx_st WHERE state = 'done' GROUP BY tile_z""",
       {"fx_st": _STATE})
def state_report(spark, sf):
    out = ig.state_report(_state(spark, sf))
    return out.withColumns({c: F.coalesce(c, F.lit(-1)) for c in ("bytes", "width", "height")})


@query("resume_base", """
SELECT coalesce(sum(bytes), 0)::BIGINT AS bytes, count(*) AS n FROM fx_st WHERE state = 'done'""", {"fx_st": _STATE})
def resume_base(spark, sf):
    return ig.resume_base(_state(spark, sf))


@query("last_write_wins", "SELECT key, state, bytes, event_id FROM fx_state")
def last_write_wins(spark, sf):
    return ig.fold_state(fx.fetch_log(spark, sf)).select("key", "state", "bytes", "event_id")


@query("pending_work", """
SELECT s.panoid FROM fx_samples s
WHERE NOT (s.bytes % 4 <> 0 AND s.panoid IN (SELECT panoid FROM fx_scan)
           AND s.panoid IN (SELECT panoid FROM fx_kept))""")
def pending_work(spark, sf):
    samples = fx.samples(spark, sf)
    fetched = samples.join(collect.sm.scan_panos(fx.panos(spark, sf)).select("panoid"), "panoid", "left_semi").select(
        "panoid", (F.col("bytes") % 4 != 0).alias("ok"))
    return ck.pending_work(samples.select("panoid"), fetched, collect.kept_scan(spark, sf), "panoid")


@query("metadata_diff", """
SELECT * FROM (
  SELECT 'holdout' AS name, (SELECT count(*) FROM fx_holdout)::VARCHAR AS old, (SELECT count(*) FROM fx_eligible)::VARCHAR AS new
  UNION ALL SELECT 'samples', (SELECT count(*) FROM fx_samples)::VARCHAR, (SELECT count(*) FROM fx_samples)::VARCHAR
  UNION ALL SELECT 'seed', '1', '2') WHERE old IS DISTINCT FROM new""")
def metadata_diff(spark, sf):
    n = fx.samples(spark, sf).agg(F.count("*").alias("samples"))
    eligible = sp.eligible_counties(sp.group_sizes(fx.samples(spark, sf)), SPLIT["min_samples"]).agg(F.count("*").alias("n")).scalar()
    held = holdout(spark, sf).agg(F.count("*").alias("n")).scalar()
    return ck.metadata_diff(n.withColumns({"seed": F.lit(1), "holdout": held}),
                            n.withColumns({"seed": F.lit(2), "holdout": eligible}))


@query("metadata_state", """
SELECT panoid, CASE WHEN b IN (0, 1) THEN 'meta_fail' ELSE 'meta_ok' END AS state,
  CASE b WHEN 0 THEN 'absent' WHEN 1 THEN 'no-imglayer' END AS error,
  coalesce(CASE WHEN b > 1 THEN CASE WHEN part = 'national' THEN 2 WHEN b > 3 THEN 3 ELSE 2 END END, -1)::INT AS tile_z
FROM (SELECT *, bytes % 6 AS b FROM fx_samples)""")
def metadata_state(spark, sf):
    s = fx.samples(spark, sf)
    b = F.col("bytes") % 6
    level = lambda n: F.struct(F.lit(n).alias("ImgLevel"), F.lit(2**n).alias("BlockX"), F.lit(2 ** (n - 1)).alias("BlockY"))
    layers = F.when(b > 3, F.array(level(1), level(2), level(4))).when(b > 1, F.array(level(1)))
    answers = s.where(b != 0).select("panoid", F.to_json(F.struct(layers.alias("ImgLayer"), F.lit("20190101").alias("Date"))).alias("body"))
    out = ig.apply_metadata(s, answers)
    return out.select("panoid", "state", "error", F.coalesce("tile_z", F.lit(-1)).alias("tile_z"))
