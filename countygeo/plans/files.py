"""Queries over files that Spark first writes from the tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from countygeo.operators import checks as ck
from countygeo.operators import ingest as ig
from countygeo.operators import labels as lb
from countygeo.operators import reports as rp
from countygeo.operators import vehicles as vh
from countygeo.plans import collect, evaluation, prediction, runs, splitting, vehicle
from countygeo.plans import fixtures as fx
from countygeo.plans.registry import query, r6
from countygeo.runtime import checkpoint, scratch_path
from countygeo.sources import readers, sinks


@query("coverage_json", "SELECT vehicle, year, adcode FROM fx_cov", {"fx_cov": vehicle._COV})
def coverage_json(spark, sf):
    """Coverage written per vehicle as nested JSON and read back."""
    years = vh.coverage_union(vehicle.coverage(spark, sf))
    per = years.groupBy("vehicle").agg(F.map_from_entries(F.collect_list(F.struct("year", "codes"))).alias("y"))
    doc = per.select(F.create_map("vehicle", "y").alias("coverage"))
    path = scratch_path(spark, "coverage")
    doc.write.json(path)
    return readers.read_coverage(spark, path, multi_line=False)


@query("pool_roundtrip", "SELECT panoid, adcode, lng, lat, part, vehicle, date, city FROM fx_pool")
def pool_roundtrip(spark, sf):
    path = scratch_path(spark, "pool")
    sinks.write_pool(collect.pool(spark, sf), path)
    return spark.read.schema(readers.schemas.POOL).json(path)


@query("points_roundtrip", "SELECT adcode, seq, lng, lat FROM fx_points")
def points_roundtrip(spark, sf):
    path = scratch_path(spark, "points")
    sinks.write_points(collect.sm.point_table(collect.kept_scan(spark, sf)), path)
    return readers.read_points(spark, path)


@query("samples_roundtrip", "SELECT panoid, adcode, lng, lat, part, vehicle, date, city, width, height FROM fx_samples")
def samples_roundtrip(spark, sf):
    path = scratch_path(spark, "samples")
    fx.samples(spark, sf).write.json(path)
    return readers.read_samples(spark, path).drop("obsolete")


@query("split_roundtrip", "SELECT panoid, split FROM fx_split")
def split_roundtrip(spark, sf):
    path = scratch_path(spark, "split")
    split = splitting.split(spark, sf).select("panoid", "split")
    sinks.write_split(split, splitting.holdout(spark, sf).select("adcode"), {"budget": 3.0}, 1, path)
    return spark.read.schema(split.schema).parquet(f"{path}/assignments")


@query("probabilities_roundtrip", "SELECT sample_id, adcode, round(p, 6) AS p FROM fx_probs JOIN fx_classes USING (class_idx)")
def probabilities_roundtrip(spark, sf):
    path = scratch_path(spark, "probabilities")
    rows = lb.with_classes(prediction.probs(spark, sf), fx.classes(spark, sf), "adcode")
    sinks.write_probabilities(rows, F.transform("classes", lambda c: c["adcode"]), path)
    back = spark.read.schema("sample_id bigint, county_probabilities map<string,double>").json(path)
    return back.select("sample_id", F.explode("county_probabilities").alias("adcode", "p")).withColumn("p", r6("p"))


@query("split_documents", "SELECT panoid, split FROM fx_split")
def split_documents(spark, sf):
    path = scratch_path(spark, "split-documents")
    sinks.write_split_documents(splitting.split(spark, sf).select("panoid", "split"), 1, path)
    return readers.read_split(spark, path)[0]


@query("loose_files", """
SELECT page_id::VARCHAR AS key, strlen(html)::BIGINT AS size, sha256(html) AS sha256, url FROM pages WHERE html <> ''""")
def loose_files(spark, sf):
    """Every page as a loose file with its address in a sidecar, written by the tasks and read back."""
    path = scratch_path(spark, "loose")
    pages = fx.table(spark, sf, "pages")
    sinks.write_files(pages.select(F.col("page_id").cast("string").alias("key"), F.col("html").cast("binary").alias("content"),
                                   F.to_json(F.struct("url")).alias("meta")), path)
    return readers.read_files(spark, path).select(
        "key", "size", F.sha2("content", 256).alias("sha256"), F.get_json_object("meta", "$.url").alias("url"))


@query("split_meta", """
SELECT 'count' AS kind, split AS name, count(*) AS n FROM fx_split GROUP BY split
UNION ALL SELECT 'holdout', adcode, 1 FROM fx_holdout
UNION ALL SELECT DISTINCT 'present', adcode, 1 FROM fx_samples JOIN fx_split USING (panoid) WHERE split = 'test_county'""")
def split_meta(spark, sf):
    """Counts, held-out and present test counties of a written split."""
    path = scratch_path(spark, "split-meta")
    split = splitting.split(spark, sf).select("panoid", "split")
    sinks.write_split(split, splitting.holdout(spark, sf).select("adcode"), {"budget": 3.0}, 1, path, fx.samples(spark, sf))
    meta = spark.read.schema(readers.schemas.SPLIT_FILE).json(f"{path}/meta")

    def codes(column, kind):
        return meta.select(F.lit(kind).alias("kind"), F.explode(column).alias("name"), F.lit(1).cast("bigint").alias("n"))

    return (meta.select(F.lit("count").alias("kind"), F.explode("counts").alias("name", "n"))
            .unionByName(codes("holdout_adcodes", "holdout")).unionByName(codes("test_counties_present", "present")))


@query("positions_roundtrip", "SELECT sample_id, round(truth_lng, 10) AS truth_lng, round(truth_lat, 10) AS truth_lat FROM fx_truth")
def positions_roundtrip(spark, sf):
    """Truth of every sample from written positions."""
    path = scratch_path(spark, "positions")
    truth = fx.truth(spark, sf)
    sinks.write_positions(truth.select("sample_id", F.col("truth_lng").alias("lng"), F.col("truth_lat").alias("lat")), path)
    given = readers.read_positions(spark, path).withColumn("sample_id", F.col("sample_id").cast("bigint"))
    return rp.explicit_truth(truth.select("sample_id"), given).select(
        "sample_id", F.round("truth_lng", 10).alias("truth_lng"), F.round("truth_lat", 10).alias("truth_lat"))


@query("boundaries_roundtrip", """
SELECT adcode, round(x1, 6) AS x1, round(y1, 6) AS y1, round(x2, 6) AS x2, round(y2, 6) AS y2 FROM fx_poly_edges""")
def boundaries_roundtrip(spark, sf):
    folder = scratch_path(spark, "boundaries")
    sinks.write_boundaries(fx.poly_edges(spark, sf), folder)
    return readers.read_boundaries(spark, folder).select("adcode", *[r6(c).alias(c) for c in ("x1", "y1", "x2", "y2")])


@query("run_log_roundtrip", """
SELECT epoch, round(train_loss, 5) AS train_loss, round(train_acc, 6) AS top1, steps AS n FROM fx_epochs""",
       {**runs._SV, "fx_epochs": runs._EPOCHS})
def run_log_roundtrip(spark, sf):
    path = scratch_path(spark, "run-log")
    runs.epochs(spark, sf).select("epoch", "train_loss", "minutes", F.struct(
        F.col("train_acc").alias("top1"), F.col("steps").alias("n")).alias("val_same")).write.json(path)
    return readers.read_run_log(spark, path).select(
        "epoch", F.round("train_loss", 5).alias("train_loss"), r6("val_same.top1").alias("top1"), F.col("val_same.n").alias("n"))


@query("histogram_roundtrip", collect.HISTOGRAM, {"fx_hist": collect._COUNTY_HIST})
def histogram_roundtrip(spark, sf):
    path = scratch_path(spark, "histogram")
    scan = collect.kept_scan(spark, sf)
    pool = collect.pool(spark, sf)
    totals = collect.sm.coverage_totals(scan, pool, collect.sm.point_table(scan), **collect.QUOTAS)
    sinks.write_histogram(collect.sm.coverage_histogram(scan, pool, **collect.QUOTAS), totals, path)
    entry = "map<string,struct<available:bigint,selected:bigint,quota:bigint>>"
    back = spark.read.schema(f"provinces {entry}, counties {entry}").json(path)

    def level(column, name):
        return back.select(F.lit(name).alias("level"), F.explode(column).alias("code", "v")).select("level", "code", "v.*")

    return level("counties", "county").unionByName(level("provinces", "province"))


def written_shards(spark, sf):
    """Folder of shards, listing and manifest of all finished rows."""
    path = scratch_path(spark, "shards")
    sharded = checkpoint(ig.assign_shards(splitting.done_rows(spark, sf), 50_000_000))
    missing = ck.missing_keys(fx.samples(spark, sf), collect.pool(spark, sf), "panoid")
    sinks.write_shards(sharded, path, missing)
    return path


@query("shards_roundtrip", "SELECT s.panoid, s.shard, d.adcode FROM fx_shards s JOIN fx_samples d USING (panoid)", {"fx_shards": splitting._SHARDS})
def shards_roundtrip(spark, sf):
    path = written_shards(spark, sf)
    listed = spark.read.schema("panoid string, adcode string").json(f"{path}/listing")
    placed = spark.read.schema("panoid string, shard bigint").parquet(f"{path}/samples")
    return listed.join(placed, "panoid").join(fx.samples(spark, sf).select("panoid"), "panoid", "left_semi")


@query("manifest_roundtrip", """
SELECT shard, count(*) AS samples, sum(bytes)::BIGINT AS bytes,
  (SELECT count(*) FROM (SELECT panoid FROM fx_samples EXCEPT SELECT panoid FROM fx_pool)) AS missing_count,
  (SELECT string_agg(panoid, ',' ORDER BY panoid) FROM (
     SELECT panoid FROM fx_samples EXCEPT SELECT panoid FROM fx_pool ORDER BY panoid LIMIT 50)) AS missing
FROM fx_shards GROUP BY shard""", {"fx_shards": splitting._SHARDS})
def manifest_roundtrip(spark, sf):
    doc = spark.read.schema("shards array<struct<shard:bigint,samples:bigint,bytes:bigint>>, missing array<string>, missing_count bigint").json(
        f"{written_shards(spark, sf)}/manifest")
    return doc.select(F.inline("shards"), "missing_count", F.array_join("missing", ",").alias("missing"))


@query("results_roundtrip", """
SELECT sample_id, truth, landed, round(km, 6) AS km, hit1, hit5, landed_hit FROM fx_rows""", evaluation.EV)
def results_roundtrip(spark, sf):
    path = scratch_path(spark, "results")
    sinks.write_results(evaluation.rows(spark, sf), path)
    back = spark.read.schema("sample_id bigint, truth string, landed string, km double, hit1 boolean, hit5 boolean, landed_hit boolean").json(path)
    return back.withColumn("km", r6("km"))


@query("id_identity", """
SELECT sum(c)::BIGINT AS n, sha256(string_agg(h, ',' ORDER BY b)) AS sha256 FROM (
  SELECT substr(h, 1, 4) AS b, sum(c) AS c, sha256(string_agg(h || ':' || c, ',' ORDER BY h)) AS h FROM (
    SELECT sha256(CAST(vec_id AS VARCHAR)) AS h, count(*) AS c FROM embeddings GROUP BY 1) GROUP BY 1)""")
def id_identity(spark, sf):
    return rp.ordered_digest(fx.table(spark, sf, "embeddings"), F.col("vec_id").cast("string"))


def _digest(entry: str, table: str) -> str:
    """SQL of ``ordered_digest`` over the entries of a table."""
    return f"""SELECT coalesce(sum(c), 0)::BIGINT AS n, coalesce(sha256(string_agg(h, ',' ORDER BY b)), sha256('')) AS sha256 FROM (
  SELECT substr(h, 1, 4) AS b, sum(c) AS c, sha256(string_agg(h || ':' || c, ',' ORDER BY h)) AS h FROM (
    SELECT sha256({entry}) AS h, count(*) AS c FROM {table} GROUP BY 1) GROUP BY 1)"""


def page_identity(spark, sf, content="html", place="page_id", preprocess="html"):
    """Identity of all pages: each one's bytes as the file of its id, ids in order."""
    pages = fx.table(spark, sf, "pages").select("page_id", "html")
    files = pages.select(F.col("page_id").cast("string").alias("path"), F.expr(content).cast("binary").alias("content"))
    ids = pages.select(F.col("page_id").alias("sample_id"), F.expr(place).alias("place"))
    return rp.cache_identity(files, ids, preprocess=preprocess, order="place")


@query("cache_identity", f"""
SELECT 3 AS version, f.n AS n_files, f.sha256 AS files_sha256, i.n AS n_ids, i.sha256 AS ids_sha256, 'html' AS preprocess
FROM ({_digest("concat_ws('|', page_id::VARCHAR, sha256(html))", "pages")}) f,
  ({_digest("page_id::VARCHAR || '|' || page_id::VARCHAR", "pages")}) i""")
def cache_identity(spark, sf):
    return page_identity(spark, sf)


@query("identity_changes", """
SELECT * FROM (VALUES ('none', true, ''), ('byte', false, 'files_sha256'), ('order', false, 'ids_sha256'),
  ('preprocess', false, 'preprocess')) t(change, same, changed) WHERE EXISTS (SELECT * FROM pages)""")
def identity_changes(spark, sf):
    """A stored identity against the present inputs, and against inputs with one byte, the order or the preparation changed."""
    path = scratch_path(spark, "identity")
    page_identity(spark, sf).write.parquet(path)
    stored = spark.read.parquet(path)
    first = fx.table(spark, sf, "pages").agg(F.min("page_id")).first()[0]
    byte = f"CASE WHEN page_id = {first} THEN concat(coalesce(html, ''), 'x') ELSE html END" if first is not None else "html"
    current = {"none": {}, "byte": {"content": byte}, "order": {"place": "-page_id"}, "preprocess": {"preprocess": "text"}}
    rows = [rp.identity_changes(stored, page_identity(spark, sf, **how)).select(
        F.lit(name).alias("change"), "same", F.array_join("changed", ",").alias("changed")) for name, how in current.items()]
    return reduce(DataFrame.unionByName, rows)


@query("fingerprint")
def fingerprint(spark, sf):
    """Cache identity from the input files and the sample ids."""
    files = spark.read.format("binaryFile").load([f"{sf}/embeddings.parquet", f"{sf}/nation.parquet"]).select(
        F.regexp_extract("path", r"([^/]+)$", 1).alias("path"), "content")
    ids = fx.table(spark, sf, "embeddings").select(F.col("vec_id").alias("sample_id"))
    return rp.cache_identity(files, ids)
