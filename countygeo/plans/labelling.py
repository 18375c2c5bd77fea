"""Class space, label index, vehicle classes and soft labels."""

from __future__ import annotations

from pyspark.sql import functions as F

from countygeo.operators import checks as ck
from countygeo.operators import labels as lb
from countygeo.operators import sampling as sm
from countygeo.plans import collect, splitting
from countygeo.plans import fixtures as fx
from countygeo.plans.registry import query, r6

VEHICLE = {"min_samples": 5, "min_dates": 2}


def points(spark, sf):
    return sm.point_table(collect.kept_scan(spark, sf))


_SPACE = """
SELECT adcode, CAST(row_number() OVER (ORDER BY adcode) - 1 AS INT) AS class_idx FROM (
  SELECT adcode FROM fx_samples GROUP BY adcode HAVING count(*) >= 3 INTERSECT SELECT adcode FROM fx_points)"""


@query("class_space", "SELECT adcode, class_idx FROM fx_space", {"fx_space": _SPACE})
def class_space(spark, sf):
    return lb.class_space(fx.samples(spark, sf), points(spark, sf), 3)


@query("centroids", "SELECT adcode, round(avg(lng), 6) AS lng, round(avg(lat), 6) AS lat FROM fx_points GROUP BY adcode")
def centroids(spark, sf):
    return lb.centroids(points(spark, sf)).select("adcode", r6("lng").alias("lng"), r6("lat").alias("lat"))


@query("label_index", """
SELECT panoid, coalesce(class_idx, -1) AS class_idx, city_idx, province_idx,
  round((lng - 73.0) / 62.0, 6) AS coord_x, round((lat - 18.0) / 36.0, 6) AS coord_y
FROM (SELECT *, CAST(dense_rank() OVER (ORDER BY city_code) - 1 AS INT) AS city_idx,
             CAST(dense_rank() OVER (ORDER BY substr(adcode, 1, 2)) - 1 AS INT) AS province_idx
      FROM (SELECT *, CASE WHEN substr(adcode, 3, 2) = '90' THEN substr(adcode, 1, 2) || '0000'
                           ELSE substr(adcode, 1, 4) || '00' END AS city_code FROM fx_samples)) s
LEFT JOIN fx_space ON s.adcode = fx_space.adcode""", {"fx_space": _SPACE})
def label_index(spark, sf):
    s = fx.samples(spark, sf)
    out = lb.label_index(s, lb.class_space(s, points(spark, sf), 3))
    return out.withColumns({"coord_x": r6("coord_x"), "coord_y": r6("coord_y")})


_VEHICLES = """
SELECT vehicle, CAST(row_number() OVER (ORDER BY vehicle) - 1 AS INT) AS vehicle_idx, n, dates FROM (
  SELECT upper(vehicle) AS vehicle, count(*) AS n, count(DISTINCT date) AS dates FROM fx_train
  WHERE right(vehicle, 2) NOT IN ('IN', 'OI', 'UZ') GROUP BY 1 HAVING count(*) >= 5 AND count(DISTINCT date) >= 2)"""


@query("vehicle_classes", "SELECT vehicle, vehicle_idx, n, dates FROM fx_vehicles", {"fx_vehicles": _VEHICLES})
def vehicle_classes(spark, sf):
    return lb.vehicle_classes(lb.vehicle_days(fx.samples(spark, sf), splitting.split(spark, sf)), **VEHICLE)


@query("vehicle_label_index", """
SELECT panoid, coalesce(vehicle_idx, -1) AS vehicle_idx, coalesce(y.idx, -1) AS year_idx, coalesce(p.idx, -1) AS prefix_idx
FROM (SELECT panoid, CASE WHEN right(vehicle, 2) IN ('IN', 'OI', 'UZ') THEN '' ELSE upper(vehicle) END AS vehicle,
             substr(date, 1, 4) AS year FROM fx_samples) s
LEFT JOIN fx_vehicles v ON s.vehicle = v.vehicle
LEFT JOIN (SELECT year, CAST(row_number() OVER (ORDER BY year) - 1 AS INT) AS idx
           FROM (SELECT DISTINCT substr(date, 1, 4) AS year FROM fx_train)) y ON s.year = y.year
LEFT JOIN (SELECT prefix, CAST(row_number() OVER (ORDER BY prefix) - 1 AS INT) AS idx
           FROM (SELECT DISTINCT substr(vehicle, 1, 3) AS prefix FROM fx_vehicles)) p ON substr(s.vehicle, 1, 3) = p.prefix""",
       {"fx_vehicles": _VEHICLES})
def vehicle_label_index(spark, sf):
    return lb.vehicle_label_index(fx.samples(spark, sf), splitting.split(spark, sf), **VEHICLE)


@query("vehicles_without_prior", """
SELECT vehicle FROM fx_vehicles WHERE vehicle NOT IN (SELECT upper(vehicle) FROM fx_samples WHERE vehicle IS NOT NULL)""",
       {"fx_vehicles": _VEHICLES})
def vehicles_without_prior(spark, sf):
    return ck.unsupported_vehicles(vehicle_classes(spark, sf), fx.samples(spark, sf))


@query("soft_targets", "SELECT class_i, class_j, round(w, 6) AS w FROM fx_soft")
def soft_targets(spark, sf):
    return lb.soft_targets(fx.classes(spark, sf)).select("class_i", "class_j", r6("w").alias("w"))


@query("soft_diagonal", """
SELECT round(quantile_cont(w, 0.5), 6) AS median_w, round(min(w), 6) AS min_w FROM fx_soft WHERE class_i = class_j""")
def soft_diagonal(spark, sf):
    return lb.soft_diagonal(fx.classes(spark, sf)).select(r6("median_w").alias("median_w"), r6("min_w").alias("min_w"))
