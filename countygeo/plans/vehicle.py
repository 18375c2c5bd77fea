"""Vehicle coverage and prior queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from countygeo.functions import scalar as sc
from countygeo.functions.arrays import softmax
from countygeo.operators import labels as lb
from countygeo.operators import vehicles as vh
from countygeo.plans import fixtures as fx
from countygeo.plans import prediction
from countygeo.plans.registry import query, r6
from countygeo.runtime import checkpoint, spread


def coverage(spark, sf):
    """(vehicle, year, adcode) seen in the samples; labels are made of distinct days, not of each sample."""
    days = fx.samples(spark, sf).select("vehicle", "date", "adcode").distinct()
    # The label is generated: a filter on a projected one would be moved below the distinct and run on each sample.
    return days.select(F.explode(F.array(sc.vehicle_label("vehicle"))).alias("vehicle"), sc.year_label("date").alias("year"), "adcode").where(
        F.col("vehicle") != "").distinct()


_COV = """
SELECT DISTINCT upper(vehicle) AS vehicle, substr(date, 1, 4) AS year, adcode FROM fx_samples
WHERE right(vehicle, 2) NOT IN ('IN', 'OI', 'UZ')"""


@query("coverage_union", """
SELECT vehicle, year, string_agg(adcode, ',' ORDER BY adcode) AS codes FROM fx_cov GROUP BY vehicle, year""", {"fx_cov": _COV})
def coverage_union(spark, sf):
    return vh.coverage_union(coverage(spark, sf)).withColumn("codes", F.array_join("codes", ","))


def vehicle_preds(spark, sf, seen):
    """Vehicle and year distributions of each sample as maps.

    The classes are all vehicles, lower case to exercise the normalisation, and
    six years of which some are not covered.
    """
    classes = seen.select("vehicle").distinct().select("vehicle", (F.row_number().over(lb.W.orderBy("vehicle")) - 1).alias("class_idx"))
    rows = lb.with_classes(spread(fx.table(spark, sf, "embeddings"), "vec_id"), classes, "vehicle", out="cls")
    v_logits = F.transform("cls", lambda c: F.get("embedding", (F.lit(20) + c["class_idx"] % 20).cast("int")).cast("double") * 5.0)
    years = F.array(*[F.lit(str(y)) for y in (1993, 1995, 1996, 1997, 1998, 2020)])
    y_logits = F.transform(F.slice("embedding", 11, 6), lambda x: x.cast("double") * 5.0)
    return rows.select(
        F.col("vec_id").alias("sample_id"),
        F.map_from_arrays(F.transform("cls", lambda c: F.lower(c["vehicle"])), softmax(v_logits)).alias("vehicle_probs"),
        F.map_from_arrays(years, softmax(y_logits)).alias("year_probs"))


_VP = {
    "fx_cov": _COV,
    "fx_fleet": """
SELECT vehicle, row_number() OVER (ORDER BY vehicle) - 1 AS i FROM (
  SELECT DISTINCT vehicle FROM fx_cov)""",
    "fx_vp": """
SELECT sample_id, vehicle, exp(l) / sum(exp(l)) OVER (PARTITION BY sample_id) AS pv FROM (
  SELECT vec_id AS sample_id, vehicle, CAST(embedding[20 + i % 20 + 1] AS DOUBLE) * 5.0 AS l FROM embeddings, fx_fleet)""",
    "fx_yp": """
SELECT sample_id, year, exp(l) / sum(exp(l)) OVER (PARTITION BY sample_id) AS py FROM (
  SELECT vec_id AS sample_id, unnest(['1993', '1995', '1996', '1997', '1998', '2020']) AS year,
         unnest(embedding[11:16])::DOUBLE * 5.0 AS l FROM embeddings)""",
    "fx_allowed": "SELECT adcode FROM fx_classes WHERE class_idx % 3 <> 0",
    "fx_vcov": "SELECT c.* FROM fx_cov c JOIN fx_fleet USING (vehicle) WHERE adcode IN (SELECT adcode FROM fx_allowed)",
    "fx_mass": """
SELECT sample_id, vehicle, year, pv * py AS mass, EXISTS (SELECT 1 FROM fx_vcov c WHERE c.vehicle = v.vehicle AND c.year = y.year) AS known
FROM fx_vp v JOIN fx_yp y USING (sample_id) WHERE v.vehicle IN (SELECT vehicle FROM fx_vcov)""",
    "fx_spread": """
SELECT sample_id, adcode, mass / count(*) OVER (PARTITION BY sample_id, vehicle, year) AS m FROM (
  SELECT m.*, adcode FROM fx_mass m JOIN fx_vcov c ON m.vehicle = c.vehicle AND m.year = c.year WHERE known
  UNION ALL
  SELECT m.*, adcode FROM fx_mass m JOIN (SELECT DISTINCT vehicle, adcode FROM fx_vcov) c ON m.vehicle = c.vehicle WHERE NOT known)""",
    "fx_prior": """
SELECT sample_id, adcode, m / sum(m) OVER (PARTITION BY sample_id) AS p, sum(m) OVER (PARTITION BY sample_id) AS mass
FROM (SELECT sample_id, adcode, sum(m) AS m FROM fx_spread GROUP BY 1, 2)""",
}


def prior(spark, sf):
    """Vehicle predictions and the prior they give; both start from stored tables."""
    allowed = fx.classes(spark, sf).where(F.col("class_idx") % 3 != 0)
    seen = checkpoint(coverage(spark, sf))
    preds = checkpoint(vehicle_preds(spark, sf, seen))
    return preds, vh.coverage_prior(preds, seen, allowed)


@query("coverage_prior", "SELECT sample_id, adcode, round(p, 6) AS p, round(mass, 6) AS mass FROM fx_prior", _VP)
def coverage_prior(spark, sf):
    return prior(spark, sf)[1].select("sample_id", "supported_mass", F.explode("prior").alias("adcode", "p")).select(
        "sample_id", "adcode", r6("p").alias("p"), r6("supported_mass").alias("mass"))


@query("blend_prior", """
SELECT sample_id, class_idx, applied, round(CASE WHEN applied THEN 0.75 * p + 0.25 * pq / sum(pq) OVER (PARTITION BY sample_id) ELSE p END, 6) AS blended
FROM (
  SELECT e.sample_id, class_idx, e.p, conf >= 0.03 AND coalesce(s.mass, 0) >= 0.5 AS applied,
         e.p * (0.9 * coalesce(q.p, 0) + 0.1 / (SELECT count(*) FROM fx_classes)) AS pq
  FROM fx_probs e JOIN fx_classes USING (class_idx) LEFT JOIN fx_prior q ON e.sample_id = q.sample_id AND q.adcode = fx_classes.adcode
  JOIN (SELECT sample_id, max(pv) AS conf FROM fx_vp GROUP BY 1) c ON c.sample_id = e.sample_id
  LEFT JOIN (SELECT sample_id, max(mass) AS mass FROM fx_prior GROUP BY 1) s ON s.sample_id = e.sample_id)""", _VP)
def blend_prior(spark, sf):
    preds, found = prior(spark, sf)
    preds = preds.select("sample_id", F.array_max(F.map_values("vehicle_probs")).alias("confidence"))
    env = prediction.probs(spark, sf).select("sample_id", F.col("probs").alias("env"))
    codes = [r["adcode"] for r in fx.classes(spark, sf).orderBy("class_idx").collect()]
    rows = env.join(preds, "sample_id").join(vh.align_prior(found, codes), "sample_id")
    out = vh.blend_prior(rows, 0.25, 0.03)
    return out.select("sample_id", "applied", F.posexplode("blended").alias("class_idx", "blended")).select(
        "sample_id", "class_idx", "applied", r6("blended").alias("blended"))
