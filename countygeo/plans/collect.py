"""Collection queries: scan, sampling, thinning, histogram."""

from __future__ import annotations

from pyspark.sql import functions as F

from countygeo.operators import sampling as sm
from countygeo.plans import fixtures as fx
from countygeo.plans.oracle_views import QUOTA, gx, gy
from countygeo.plans.registry import query

# Quotas small enough to bind at the test scales.
QUOTAS = {"per_county": 5, "focus": 10}


def kept_scan(spark, sf):
    return sm.exclude_prefixes(sm.scan_panos(fx.panos(spark, sf)))


def pool(spark, sf):
    return sm.sample_pool(kept_scan(spark, sf), **QUOTAS)


@query("pano_scan", "SELECT panoid, lng, lat, adcode FROM fx_scan")
def pano_scan(spark, sf):
    return sm.scan_panos(fx.panos(spark, sf))


@query("exclude_prefix", "SELECT panoid, lng, lat, adcode FROM fx_kept")
def exclude_prefix(spark, sf):
    return kept_scan(spark, sf)


@query("scan_limit", "SELECT panoid, lng, lat, adcode FROM fx_scan ORDER BY panoid LIMIT 1000")
def scan_limit(spark, sf):
    return sm.first_rows(sm.scan_panos(fx.panos(spark, sf)), 1000)


@query("pool_candidates", "SELECT * FROM fx_cand")
def pool_candidates(spark, sf):
    return sm.candidates(kept_scan(spark, sf))


@query("reservoir", "SELECT * FROM fx_reservoir")
def reservoir(spark, sf):
    return sm.reservoir(sm.candidates(kept_scan(spark, sf)), **QUOTAS)


@query("thin_grid", f"""
SELECT panoid, adcode, lng, lat FROM (
  SELECT *, row_number() OVER (PARTITION BY adcode, {gx(300.0)}, {gy(300.0)} ORDER BY panoid) AS rn FROM fx_kept)
WHERE rn = 1""")
def thin_grid(spark, sf):
    return sm.thin_grid(kept_scan(spark, sf), 300.0, ["panoid"]).select("panoid", "adcode", "lng", "lat")


@query("sample_pool", "SELECT * FROM fx_pool")
def sample_pool(spark, sf):
    return pool(spark, sf)


@query("point_table", "SELECT adcode, seq, lng, lat FROM fx_points")
def point_table(spark, sf):
    return sm.point_table(kept_scan(spark, sf))


@query("county_available", """
SELECT 'county' AS level, adcode AS code, count(*) AS n FROM fx_kept GROUP BY adcode
UNION ALL
SELECT 'province', substr(adcode, 1, 2) || '0000', count(*) FROM fx_kept GROUP BY 2""")
def county_available(spark, sf):
    return sm.county_counts(kept_scan(spark, sf))


@query("county_selected", """
SELECT 'county' AS level, adcode AS code, count(*) AS n FROM fx_pool GROUP BY adcode
UNION ALL
SELECT 'province', substr(adcode, 1, 2) || '0000', count(*) FROM fx_pool GROUP BY 2""")
def county_selected(spark, sf):
    return sm.county_counts(pool(spark, sf))


_COUNTY_HIST = f"""
SELECT a.adcode, available, coalesce(selected, 0) AS selected, {QUOTA.replace('adcode', 'a.adcode')} AS quota
FROM (SELECT adcode, count(*) AS available FROM fx_kept GROUP BY adcode) a
LEFT JOIN (SELECT adcode, count(*) AS selected FROM fx_pool GROUP BY adcode) s ON a.adcode = s.adcode"""


HISTOGRAM = """
SELECT 'county' AS level, adcode AS code, available, selected, quota::BIGINT AS quota FROM fx_hist
UNION ALL
SELECT 'province', substr(adcode, 1, 2) || '0000', sum(available)::BIGINT, sum(selected)::BIGINT, count(*) * 5
FROM fx_hist GROUP BY 2"""


@query("coverage_histogram", HISTOGRAM, {"fx_hist": _COUNTY_HIST})
def coverage_histogram(spark, sf):
    scan = kept_scan(spark, sf)
    return sm.coverage_histogram(scan, sm.sample_pool(scan, **QUOTAS), **QUOTAS)


@query("coverage_totals", """
SELECT sum(available)::BIGINT AS scanned_rows, count(DISTINCT substr(adcode, 1, 2)) AS provinces_with_data,
  count(*) FILTER (adcode LIKE '51%') AS focus_counties,
  count(*) FILTER (adcode LIKE '51%' AND available > 0) AS focus_counties_covered,
  count(*) FILTER (available < quota) AS counties_under_quota,
  (SELECT count(*) FROM fx_pool) AS sample_rows,
  (SELECT count(*) FROM fx_pool WHERE part = 'sichuan') AS focus_rows,
  (SELECT count(*) FROM fx_pool WHERE part = 'national') AS other_rows,
  (SELECT count(DISTINCT adcode) FROM fx_points) AS counties_with_points,
  (SELECT count(*) FROM fx_points) AS points_total
FROM fx_hist""", {"fx_hist": _COUNTY_HIST})
def coverage_totals(spark, sf):
    scan = kept_scan(spark, sf)
    return sm.coverage_totals(scan, sm.sample_pool(scan, **QUOTAS), sm.point_table(scan), **QUOTAS)


@query("under_quota", """
SELECT adcode, count(*) AS available, (CASE WHEN adcode LIKE '51%' THEN 100 ELSE 50 END)::BIGINT AS quota
FROM fx_kept GROUP BY adcode HAVING count(*) < CASE WHEN adcode LIKE '51%' THEN 100 ELSE 50 END""")
def under_quota(spark, sf):
    return sm.under_quota(kept_scan(spark, sf))


@query("county_summary", """
SELECT k.adcode, substr(k.adcode, 1, 2) || '0000' AS province, available, coalesce(selected, 0) AS selected
FROM (SELECT adcode, count(*) AS available FROM fx_kept GROUP BY adcode) k
LEFT JOIN (SELECT adcode, count(*) AS selected FROM fx_pool GROUP BY adcode) s ON k.adcode = s.adcode""")
def county_summary(spark, sf):
    """Flagship: scan, filter, parse, reservoir, thinning, quota, counts."""
    scan = kept_scan(spark, sf)
    hist = sm.coverage_histogram(scan, sm.sample_pool(scan, **QUOTAS), **QUOTAS)
    return hist.where(F.col("level") == "county").select(
        F.col("code").alias("adcode"), F.concat(F.substring("code", 1, 2), F.lit("0000")).alias("province"),
        "available", "selected")
