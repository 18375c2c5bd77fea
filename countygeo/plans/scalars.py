"""Scalar function queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from countygeo.functions import geo
from countygeo.functions import scalar as sc
from countygeo.functions import views as vw
from countygeo.operators import reports as rp
from countygeo.plans import fixtures as fx
from countygeo.plans.oracle_views import draw, gx, gy, hav
from countygeo.plans.registry import query, r6

SEED = "7"


@query("parse_panoid", """
SELECT panoid, substr(panoid, 1, 3) || '_' || substr(panoid, 7, 4) || '_' || right(panoid, 2) AS vehicle,
       substr(panoid, 11, 6) AS date, substr(panoid, 4, 3) AS city FROM fx_panos""")
def parse_panoid(spark, sf):
    return fx.panos(spark, sf).select("panoid", sc.parse_panoid("panoid").alias("id")).select("panoid", "id.*")


@query("admin_codes", """
SELECT DISTINCT adcode, substr(adcode, 1, 2) || '0000' AS province,
  CASE WHEN substr(adcode, 3, 2) = '90' THEN substr(adcode, 1, 2) || '0000' ELSE substr(adcode, 1, 4) || '00' END AS label_city,
  CASE WHEN substr(adcode, 1, 2) IN ('11', '12', '31', '50') THEN substr(adcode, 1, 2) || '0000'
       WHEN substr(adcode, 3, 2) = '90' THEN adcode ELSE substr(adcode, 1, 4) || '00' END AS display_city
FROM fx_panos""")
def admin_codes(spark, sf):
    return fx.panos(spark, sf).select(
        "adcode", sc.province_code("adcode").alias("province"), sc.label_city("adcode").alias("label_city"),
        sc.display_city("adcode").alias("display_city")).distinct()


@query("group_key", """
SELECT panoid, CASE WHEN adcode_status = 'failed' THEN 'solo|' || panoid
  ELSE substr(panoid, 1, 3) || '_' || substr(panoid, 7, 4) || '_' || right(panoid, 2) || '|' || date8 END AS gid
FROM fx_panos""")
def group_key(spark, sf):
    vehicle = F.when(F.col("adcode_status") != "failed", sc.parse_panoid("panoid")["vehicle"])
    return fx.panos(spark, sf).select("panoid", sc.group_key(vehicle, F.col("date8"), F.col("panoid")).alias("gid"))


@query("quota_for", """
SELECT DISTINCT adcode, CASE WHEN adcode LIKE '51%' THEN 100 ELSE 50 END AS quota,
       CASE WHEN adcode LIKE '51%' THEN 'sichuan' ELSE 'national' END AS part FROM fx_panos""")
def quota_for(spark, sf):
    return fx.panos(spark, sf).select(
        "adcode", sc.quota_for("adcode").alias("quota"), sc.part_of("adcode").alias("part")).distinct()


@query("grid_cell", f"SELECT panoid, {gx(300.0)} AS gx, {gy(300.0)} AS gy FROM fx_panos")
def grid_cell(spark, sf):
    return fx.panos(spark, sf).select(
        "panoid", geo.grid_x("lng", "lat", 300.0).alias("gx"), geo.grid_y("lat", 300.0).alias("gy"))


@query("normalize_coords", """
SELECT panoid, round((lng - 73.0) / 62.0, 6) AS x, round((lat - 18.0) / 36.0, 6) AS y,
  round(least(greatest((lng - 73.0) / 62.0 * 1.5 - 0.2, 0.0), 1.0) * 62.0 + 73.0, 6) AS lng2,
  round(least(greatest((lat - 18.0) / 36.0 * 1.5 - 0.2, 0.0), 1.0) * 36.0 + 18.0, 6) AS lat2
FROM fx_panos""")
def normalize_coords(spark, sf):
    x, y = geo.normalize_lng("lng"), geo.normalize_lat("lat")
    return fx.panos(spark, sf).select(
        "panoid", r6(x).alias("x"), r6(y).alias("y"), r6(geo.denormalize_x(x * 1.5 - 0.2)).alias("lng2"),
        r6(geo.denormalize_y(y * 1.5 - 0.2)).alias("lat2"))


@query("haversine", f"""
SELECT panoid, round({hav('lng', 'lat', '116.4074', '39.9042')}, 3) AS metres FROM fx_panos""")
def haversine(spark, sf):
    d = geo.haversine_m("lng", "lat", F.lit(116.4074), F.lit(39.9042))
    return fx.panos(spark, sf).select("panoid", F.round(d, 3).alias("metres"))


@query("local_xy", """
SELECT panoid, round((lng - 104.0) * radians(1.0) * 6371008.8 * cos(radians(30.5)), 3) AS x,
       round((lat - 30.5) * radians(1.0) * 6371008.8, 3) AS y, round(lng, 6) AS lng2, round(lat, 6) AS lat2 FROM fx_panos""")
def local_xy(spark, sf):
    lng0, lat0 = F.lit(104.0), F.lit(30.5)
    x, y = geo.local_x("lng", lng0, lat0), geo.local_y("lat", lat0)
    return fx.panos(spark, sf).select(
        "panoid", F.round(x, 3).alias("x"), F.round(y, 3).alias("y"), r6(geo.plane_lng(x, lng0, lat0)).alias("lng2"),
        r6(geo.plane_lat(y, lat0)).alias("lat2"))


@query("year_vehicle_labels", """
SELECT panoid, CASE WHEN right(panoid, 2) IN ('IN', 'OI', 'UZ') THEN '' ELSE vehicle END AS vehicle,
  substr(date, 1, 4) AS year, CASE WHEN length(d) = 8 THEN substr(d, 1, 4) ELSE 'unknown' END AS year_short,
  coalesce(nullif(substr(d, 1, 4), ''), '?') AS report_year
FROM (SELECT *, CASE WHEN width = 2048 THEN substr(date, 3, 6) ELSE date END AS d FROM fx_samples)""")
def year_vehicle_labels(spark, sf):
    short = F.when(F.col("width") == 2048, F.substring("date", 3, 6)).otherwise(F.col("date"))
    return fx.samples(spark, sf).select(
        "panoid", sc.vehicle_label(F.lower("vehicle")).alias("vehicle"), sc.year_label("date").alias("year"),
        sc.year_label(short).alias("year_short"), sc.report_year(short).alias("report_year"))


@query("trajectory_fields", """
SELECT o_orderkey AS k, CAST(year(date '1970-01-01' + CAST(o_orderkey % 20000 AS INT)) AS VARCHAR) AS year,
       CASE WHEN o_orderkey % 7 <> 0 THEN lpad(CAST(o_orderkey % 700000 - 1 AS VARCHAR), 6, '0') END AS code
FROM orders""")
def trajectory_fields(spark, sf):
    k = F.col("o_orderkey")
    code = F.when(k % 7 == 0, F.lit(0).cast("bigint")).otherwise(k % 700000)
    return fx.table(spark, sf, "orders").select(
        k.alias("k"), sc.epoch_day_year(k % 20000).alias("year"), sc.shifted_code(code).alias("code"))


@query("panorama_test", """
SELECT panoid, abs(width::DOUBLE / (height + bytes % 40) - 2.0) <= 0.02 AS loose, width = height * 2 AS strict FROM fx_samples""")
def panorama_test(spark, sf):
    return fx.samples(spark, sf).select(
        "panoid", sc.is_panorama("width", F.col("height") + F.col("bytes") % 40).alias("loose"),
        sc.is_panorama("width", "height", None).alias("strict"))


@query("id_fingerprint", "SELECT panoid, sha256(panoid) AS sha FROM fx_panos")
def id_fingerprint(spark, sf):
    return fx.panos(spark, sf).select("panoid", sc.fingerprint("panoid").alias("sha"))


@query("floored_log", "SELECT vec_id, round(ln(greatest(CAST(embedding[1] AS DOUBLE), 1e-12)), 6) AS lp FROM embeddings")
def floored_log(spark, sf):
    return fx.table(spark, sf, "embeddings").select(
        "vec_id", r6(sc.floored_log(F.get("embedding", F.lit(0)).cast("double"))).alias("lp"))


@query("game_score", """
SELECT event_id, round(5000.0 * exp(-abs(value) / 150.0), 6) AS score FROM events""")
def game_score(spark, sf):
    return fx.table(spark, sf, "events").select("event_id", r6(geo.game_score(F.abs("value"))).alias("score"))


@query("unit_draws", f"SELECT panoid, round({draw(SEED, 'panoid')}, 9) AS u FROM fx_panos")
def unit_draws(spark, sf):
    return fx.panos(spark, sf).select("panoid", F.round(sc.unit_draw(SEED, "panoid"), 9).alias("u"))


_VIEW = vw.ViewConfig(n_max=8, min_views=1, single_view_prob=0.15, fov_range=(60.0, 100.0), pitch_range=(-10.0, 10.0),
                      screenshot_prob=0.5)


def _d(salt: str) -> str:
    return draw(SEED, "panoid", "epoch", f"'{salt}'")


_PLAN = f"""
SELECT *, n_views = 1 AND {_d('shot')} < 0.5 AS is_shot FROM (
  SELECT panoid, epoch,
    CASE WHEN {_d('coin')} < 0.15 THEN 1 ELSE CAST(2 + floor({_d('count')} * 7) AS INT) END AS n_views,
    {_d('offset')} * 360.0 AS view_offset,
    60.0 + 10.0 * least(floor({_d('fov')} * 5), 4) AS view_fov,
    -10.0 + 10.0 * least(floor({_d('pitch')} * 3), 2) AS view_pitch
  FROM fx_samples, (SELECT unnest([0, 1]) AS epoch))"""


def _plan(spark, sf):
    epochs = fx.samples(spark, sf).select("panoid", F.explode(F.array(F.lit(0), F.lit(1))).alias("epoch"))
    return vw.with_view_plan(epochs, _VIEW, "panoid", F.col("epoch"), SEED)


@query("view_plan", f"""
SELECT panoid, epoch, n_views, round(view_offset, 6) AS view_offset, view_fov::DOUBLE AS view_fov,
  view_pitch::DOUBLE AS view_pitch, is_shot,
  CASE WHEN is_shot THEN round(CASE least(floor({_d('aspect')} * 3), 2) WHEN 0 THEN 1.0 WHEN 1 THEN 4.0 / 3 ELSE 16.0 / 9 END, 6) END AS aspect,
  round(view_offset + (n_views - 1) * 45.0, 6) AS last_heading, n_views AS headings,
  n_views AS mask_true, 8 AS mask_size
FROM fx_plan""", {"fx_plan": _PLAN})
def view_plan(spark, sf):
    return _plan(spark, sf).select(
        "panoid", "epoch", "n_views", r6("view_offset").alias("view_offset"), "view_fov", "view_pitch", "is_shot",
        r6("aspect").alias("aspect"), r6(F.element_at("headings", -1)).alias("last_heading"),
        F.size("headings").alias("headings"), F.size(F.filter("vmask", lambda b: b)).alias("mask_true"),
        F.size("vmask").alias("mask_size"))


@query("view_count_profile", """
SELECT epoch, n_views, is_shot, count(*) AS n FROM fx_plan GROUP BY epoch, n_views, is_shot""", {"fx_plan": _PLAN})
def view_count_profile(spark, sf):
    return _plan(spark, sf).groupBy("epoch", "n_views", "is_shot").agg(F.count("*").alias("n"))


@query("random_headings", f"""
SELECT panoid, round(least(h0, h1, h2), 6) AS lo, round(greatest(h0, h1, h2), 6) AS hi, round(h0 + h1 + h2, 5) AS total
FROM (SELECT panoid, {draw('5/heading0', 'panoid')} * 360.0 AS h0, {draw('5/heading1', 'panoid')} * 360.0 AS h1,
             {draw('5/heading2', 'panoid')} * 360.0 AS h2 FROM fx_panos)""")
def random_headings(spark, sf):
    h = vw.random_headings(3, "5", "panoid")
    return fx.panos(spark, sf).select("panoid", h.alias("h")).select(
        "panoid", r6(F.get("h", F.lit(0))).alias("lo"), r6(F.get("h", F.lit(2))).alias("hi"),
        F.round(F.get("h", F.lit(0)) + F.get("h", F.lit(1)) + F.get("h", F.lit(2)), 5).alias("total"))


def _layers(spark, sf):
    """Service metadata as JSON text with two to four layers (AMJ6)."""
    k = F.col("event_id")
    layer = lambda z: F.struct(z.alias("ImgLevel"), F.call_function("shiftleft", F.lit(1), z).alias("BlockX"),
                               F.call_function("shiftleft", F.lit(1), z - 1).alias("BlockY"))
    levels = F.transform(F.sequence((k % 2 + 1).cast("int"), (k % 3 + 2).cast("int")), lambda z: layer(z))
    return fx.table(spark, sf, "events").select(
        "event_id", F.to_json(F.struct(levels.alias("ImgLayer"), F.lit("20190101").alias("Date"))).alias("meta"))


def _parsed(spark, sf):
    schema = f"struct<ImgLayer:{vw.LAYER_SCHEMA},Date:string>"
    return _layers(spark, sf).select("event_id", F.from_json("meta", schema).alias("m")).select(
        "event_id", F.col("m.ImgLayer").alias("layers"))


@query("level_pick", """
SELECT event_id, CASE WHEN event_id % 3 + 2 >= 3 THEN 3 ELSE event_id % 3 + 2 END::INT AS level,
  event_id % 3 + 2 >= 3 AS exact, (1 << CASE WHEN event_id % 3 + 2 >= 3 THEN 3 ELSE (event_id % 3 + 2)::INT END)::INT AS bx
FROM events""")
def level_pick(spark, sf):
    return _parsed(spark, sf).select("event_id", vw.pick_layer("layers", F.lit(3)).alias("p")).select(
        "event_id", "p.level", "p.exact", "p.bx")


@query("nearest_level", """
SELECT event_id, (event_id % 2 + 1)::INT AS level, (2 << (event_id % 2)::INT)::INT AS bx FROM events""")
def nearest_level(spark, sf):
    return _parsed(spark, sf).select("event_id", vw.pick_nearest_layer("layers", 1024).alias("p")).select(
        "event_id", "p.level", "p.bx")


@query("fallback_levels", """
SELECT event_id, (event_id % 4 + 2)::INT AS z,
  CASE event_id % 4 WHEN 0 THEN '3,4' WHEN 1 THEN '2,4' WHEN 2 THEN '3,5' ELSE '4,3' END AS others,
  (1 << (event_id % 4 + 1)::INT)::INT AS tiles_x, (1 << (event_id % 4)::INT)::INT AS tiles_y
FROM events""")
def fallback_levels(spark, sf):
    z = (F.col("event_id") % 4 + 2).cast("int")
    return fx.table(spark, sf, "events").select(
        "event_id", z.alias("z"),
        F.array_join(F.transform(vw.fallback_levels(z), lambda v: v.cast("string")), ",").alias("others"),
        vw.grid_for_level(z).alias("g")).select("event_id", "z", "others", "g.tiles_x", "g.tiles_y")


@query("tier_size", """
SELECT panoid, CASE part WHEN 'sichuan' THEN 3 ELSE 2 END AS tier, CASE part WHEN 'sichuan' THEN 2048 ELSE 1024 END AS w,
       CASE part WHEN 'sichuan' THEN 1024 ELSE 512 END AS h FROM fx_samples""")
def tier_size(spark, sf):
    return fx.samples(spark, sf).select(
        "panoid", vw.tier_of("part").alias("tier"), vw.target_size("part").alias("s")).select(
        "panoid", "tier", F.col("s.width").alias("w"), F.col("s.height").alias("h"))


def names(spark, sf):
    """Division names made from the codes themselves; some levels are missing."""
    p = fx.panos(spark, sf)
    codes = p.select(F.explode(F.array(
        sc.province_code("adcode"), sc.display_city("adcode"), F.col("adcode"))).alias("adcode")).distinct()
    return codes.where(F.substring("adcode", 5, 1) != "9").select(
        "adcode", F.concat(F.lit("N"), F.substring("adcode", 1, 2), F.when(
            F.substring("adcode", 3, 4) == "0000", F.lit("")).otherwise(F.substring("adcode", 3, 4))).alias("name"))


_NAMES = """
SELECT adcode, 'N' || substr(adcode, 1, 2) || CASE WHEN substr(adcode, 3, 4) = '0000' THEN '' ELSE substr(adcode, 3, 4) END AS name
FROM (SELECT DISTINCT substr(adcode, 1, 2) || '0000' AS adcode FROM fx_panos
      UNION SELECT CASE WHEN substr(adcode, 1, 2) IN ('11', '12', '31', '50') THEN substr(adcode, 1, 2) || '0000'
                        WHEN substr(adcode, 3, 2) = '90' THEN adcode ELSE substr(adcode, 1, 4) || '00' END FROM fx_panos
      UNION SELECT adcode FROM fx_panos)"""


@query("describe_county", """
SELECT DISTINCT p.adcode, array_to_string(list_distinct_ordered, ' ') AS described FROM (
  SELECT a.adcode, CASE WHEN c.name IS NULL OR c.name = p.name THEN
      CASE WHEN n.name = p.name THEN [p.name] ELSE [p.name, n.name] END
      ELSE CASE WHEN n.name = c.name THEN [p.name, c.name] ELSE [p.name, c.name, n.name] END END AS list_distinct_ordered
  FROM (SELECT DISTINCT adcode, substr(adcode, 1, 2) || '0000' AS prov,
          CASE WHEN substr(adcode, 1, 2) IN ('11', '12', '31', '50') THEN substr(adcode, 1, 2) || '0000'
               WHEN substr(adcode, 3, 2) = '90' THEN adcode ELSE substr(adcode, 1, 4) || '00' END AS city FROM fx_panos) a
  LEFT JOIN fx_names p ON p.adcode = a.prov LEFT JOIN fx_names c ON c.adcode = a.city LEFT JOIN fx_names n ON n.adcode = a.adcode) p""",
       {"fx_names": _NAMES})
def describe_county(spark, sf):
    codes = fx.panos(spark, sf).select("adcode").distinct()
    return rp.with_description(codes, names(spark, sf))


@query("name_merge", """
SELECT coalesce(a.adcode, b.adcode) AS adcode, coalesce(b.name, a.name) AS name
FROM (SELECT adcode, name FROM fx_names WHERE substr(adcode, 1, 2) <> '65') a
FULL OUTER JOIN (SELECT adcode, 'legacy ' || name AS name FROM fx_names WHERE substr(adcode, 6, 1) IN ('3', '0')) b
ON a.adcode = b.adcode""", {"fx_names": _NAMES})
def name_merge(spark, sf):
    n = names(spark, sf)
    base = n.where(F.substring("adcode", 1, 2) != "65")
    legacy = n.where(F.substring("adcode", 6, 1).isin("3", "0")).withColumn("name", F.concat(F.lit("legacy "), "name"))
    return rp.merge_names(base, legacy)
