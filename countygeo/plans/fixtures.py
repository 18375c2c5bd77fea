"""Geolocation tables derived from the driver's relational test tables.

Each function maps (spark, sf_dir) to a table of the data model; the SQL twins
are in ``plans.oracle_views``. Coordinates are computed in decimals and cast once,
so both engines hold identical doubles.
"""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from countygeo.functions import scalar as sc
from countygeo.operators.labels import class_array
from countygeo.runtime import spread

DIMS = 64

# Schemas are given, never inferred: reading starts no job.
SCHEMAS = {
    "orders": "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double, "
              "o_orderdate timestamp_ntz, o_orderpriority string",
    "customer": "c_custkey bigint, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string",
    "nation": "n_nationkey int, n_name string, n_regionkey int",
    "events": "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string",
    "embeddings": "vec_id bigint, embedding array<float>, label int",
    "pages": "page_id bigint, url string, html string",
}


def _once(build: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
    """Keep the analysed (still lazy) table per session, folder and arguments."""
    known: dict[tuple, DataFrame] = {}

    @functools.wraps(build)
    def get(spark: SparkSession, sf_dir: str, *args: str) -> DataFrame:
        key = (spark.sparkContext.applicationId, id(spark), sf_dir, *args)
        if key not in known:
            known[key] = build(spark, sf_dir, *args)
        return known[key]

    return get


@_once
def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.schema(SCHEMAS[name]).parquet(f"{sf_dir}/{name}.parquet")


def _digits(c: Column, n: int) -> Column:
    return F.lpad(c.cast("string"), n, "0")


@_once
def panos(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Master table, one row per order (D1)."""
    orders = spread(table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderdate"), "o_orderkey")
    customer = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")
    nation = table(spark, sf_dir, "nation").select("n_nationkey", "n_regionkey")
    base = orders.join(customer, F.col("o_custkey") == F.col("c_custkey")).join(
        F.broadcast(nation), F.col("c_nationkey") == F.col("n_nationkey")).select(
        F.col("o_orderkey").alias("k"), (F.col("o_custkey") % 8).alias("d"), F.col("n_nationkey").alias("n"),
        F.col("n_regionkey").alias("r"),
        F.date_format(F.trunc(F.col("o_orderdate").cast("date"), "month"), "yyyyMMdd").alias("date8"))
    n, k, d, r = F.col("n"), F.col("k"), F.col("d"), F.col("r")
    vehicle = F.when(n % 12 == 11, F.lit("230")).otherwise(_digits(n % 12 + 90, 3))
    suffix = F.when((k % 4 == 3) & (n % 5 == 4), F.lit("IN")).otherwise(
        F.concat(F.lit("5"), F.char(n + 65)))
    province = F.element_at(F.array(*[F.lit(p) for p in ("51", "11", "31", "44", "65")]), r + 1)
    middle = F.when(n == 24, F.lit("90")).otherwise(_digits(n, 2))
    step = (k % 20).cast("decimal(10,0)") * F.expr("0.001BD")
    step_lat = (F.floor(k / 20) % 20).cast("decimal(10,0)") * F.expr("0.001BD")
    shift = d.cast("decimal(10,0)") * F.expr("0.2BD")
    panoid = F.concat(vehicle, _digits(n, 3), _digits(n * 4 + k % 4, 4), F.substring("date8", 3, 6), _digits(k, 9), suffix)
    # Ids are generated, not projected: joins on them, or on what is parsed from them, would copy the whole
    # expression into each inferred filter, in methods too long to be compiled.
    return base.withColumn("panoid", F.explode(F.array(panoid))).select(
        "panoid",
        F.concat(province, middle, _digits(d + 1, 2)).alias("adcode"),
        (n.cast("decimal(10,0)") * F.expr("2.0BD") + 75 + shift + step).cast("double").alias("lng"),
        (r.cast("decimal(10,0)") * F.expr("6.0BD") + 20 + shift + step_lat).cast("double").alias("lat"),
        "date8",
        F.when(k % 50 == 0, F.lit("hidden")).otherwise(F.lit("normal")).alias("kind"),
        F.when(k % 10 == 9, F.lit("failed")).when(k % 10 == 8, F.lit("api")).otherwise(F.lit("local")).alias(
            "adcode_status"))


@_once
def samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Packed samples with the eight-digit service date and image size (D6)."""
    p = sc.parse_panoid("panoid")
    focus = F.col("adcode").startswith(sc.FOCUS_PREFIX)
    return panos(spark, sf_dir).where(F.col("kind") == "normal").select(
        "panoid", "adcode", sc.part_of("adcode").alias("part"), "lng", "lat", p["vehicle"].alias("vehicle"),
        F.col("date8").alias("date"), p["city"].alias("city"),
        F.when(focus, 2048).otherwise(1024).alias("width"), F.when(focus, 1024).otherwise(512).alias("height"),
        (F.lit(100000) + F.substring("panoid", 17, 9).cast("bigint") % 977 * 331).alias("bytes"))


@_once
def poly_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One L-shaped boundary per county as edges, features in code order (D16)."""
    corner = panos(spark, sf_dir).select(
        "adcode", (F.floor(F.round(F.col("lng") * 1000) / 200) * F.expr("0.2BD")).alias("x"),
        (F.floor(F.round(F.col("lat") * 1000) / 200) * F.expr("0.2BD")).alias("y")).distinct()
    xs = ("-0.0055", "0.0255", "0.0255", "0.0105", "0.0105", "-0.0055")
    ys = ("-0.0055", "-0.0055", "0.0105", "0.0105", "0.0255", "0.0255")

    def at(base: str, offset: str) -> Column:
        return (F.col(base) + F.expr(f"{offset}BD")).cast("double")

    edges = F.array(*[F.struct(
        F.lit(i).alias("i"), at("x", xs[i]).alias("x1"), at("y", ys[i]).alias("y1"),
        at("x", xs[(i + 1) % 6]).alias("x2"), at("y", ys[(i + 1) % 6]).alias("y2")) for i in range(6)])
    return corner.select("adcode", F.col("adcode").cast("bigint").alias("ord"), F.inline(edges))


@_once
def classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every county as a class, with its mean coordinate (D9)."""
    from countygeo.operators.labels import dense_index

    mean = panos(spark, sf_dir).groupBy("adcode").agg(F.avg("lng").alias("lng"), F.avg("lat").alias("lat"))
    return dense_index(mean, "adcode", "class_idx").join(mean, "adcode")


@_once
def scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Logits over all classes from the embedding components (D11).

    Two thirds of the samples get extra weight on their true class.
    """
    count = classes(spark, sf_dir).agg(F.count("*").cast("int").alias("c")).scalar()
    e = spread(table(spark, sf_dir, "embeddings"), "vec_id").withColumn("__c", count).select(
        F.col("vec_id").alias("sample_id"), "embedding", "label", "__c",
        ((F.col("label") * 37 + F.col("vec_id")) % F.col("__c")).cast("int").alias("target"))

    def logit(j: Column) -> Column:
        block = F.floor(j / DIMS)
        first = F.get("embedding", j % DIMS).cast("double") * 10.0
        second = F.get("embedding", ((j + block * 5 + 11) % DIMS).cast("int")).cast("double")
        boost = F.when((j == F.col("target")) & (F.col("sample_id") % 3 != 0), 2.0).otherwise(0.0)
        return first + second + boost

    return e.select("sample_id", "target", F.transform(F.sequence(F.lit(0), F.col("__c") - 1), logit).alias("logits"))


@_once
def truth(spark: SparkSession, sf_dir: str) -> DataFrame:
    """True county and coordinate of each scored sample (D13)."""
    cls = classes(spark, sf_dir)
    s = scores(spark, sf_dir)
    return s.select("sample_id", "target").join(
        F.broadcast(cls.withColumnRenamed("class_idx", "target")), "target").select(
        "sample_id", "target", F.col("adcode").alias("truth"),
        (F.col("lng") + (F.col("sample_id") % 20 - 10) * 0.02).alias("truth_lng"),
        (F.col("lat") + (F.col("sample_id") % 15 - 7) * 0.02).alias("truth_lat"))


@_once
def fetch_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Append log of fetch states (D5)."""
    return fetch_states(table(spark, sf_dir, "events"))


def fetch_states(events: DataFrame) -> DataFrame:
    """Events as fetch states; also applied to a stream."""
    kind = F.col("event_type")
    state = (F.when(kind == "view", "pending_meta").when(kind == "click", "meta_ok").when(kind == "signup", "meta_fail")
             .when(kind == "purchase", "done").otherwise("fail"))
    return events.select(
        "event_id", F.col("user_id").alias("key"), F.col("ts").cast("timestamp").alias("updated"), state.alias("state"),
        F.round(F.col("value") * 100).cast("bigint").alias("bytes"))


def code_array(cls: DataFrame) -> Column:
    """County codes by class index, as a scalar."""
    return F.transform(class_array(cls, "adcode"), lambda c: c["adcode"])
