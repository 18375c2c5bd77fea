"""Class space, hierarchy indices, vehicle classes and geographic soft labels."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from countygeo.functions import geo
from countygeo.functions import scalar as sc
from countygeo.functions.arrays import normalize
from countygeo.runtime import checkpoint, fits_broadcast


def dense_index(codes: DataFrame, code: str, index: str) -> DataFrame:
    """0-based index of the distinct codes in sorted order (WIN10).

    Meant for class spaces: the distinct codes become outputs of a model, so one
    sorted run over them is small whatever the number of samples.
    """
    return codes.select(code).where(F.col(code).isNotNull()).distinct().withColumn(
        index, (F.row_number().over(W.orderBy(code)) - 1).cast("int"))


def class_space(samples: DataFrame, points: DataFrame, min_samples: int = 1) -> DataFrame:
    """Counties with points and enough samples of any split (AGG11)."""
    counted = samples.groupBy("adcode").agg(F.count("*").alias("n")).where(F.col("n") >= min_samples)
    with_points = points.select("adcode").distinct()
    return dense_index(counted.join(with_points, "adcode", "left_semi"), "adcode", "class_idx")


def centroids(points: DataFrame) -> DataFrame:
    """Mean coordinate of each county's points (AGG10)."""
    return points.groupBy("adcode").agg(F.avg("lng").alias("lng"), F.avg("lat").alias("lat"))


def label_index(samples: DataFrame, classes: DataFrame) -> DataFrame:
    """County, city and province labels and the coordinate target (JN5).

    Unknown counties get -1. All index tables are class spaces.
    """
    coded = samples.select(
        "panoid", "adcode", sc.label_city("adcode").alias("city"), sc.province_code("adcode").alias("province"),
        geo.normalize_lng("lng").alias("coord_x"), geo.normalize_lat("lat").alias("coord_y"))
    codes = samples.select("adcode").distinct().select(
        sc.label_city("adcode").alias("city"), sc.province_code("adcode").alias("province"))
    cities = dense_index(codes, "city", "city_idx")
    provinces = dense_index(codes, "province", "province_idx")
    return (coded.join(F.broadcast(classes), "adcode", "left")
            .join(F.broadcast(cities), "city", "left")
            .join(F.broadcast(provinces), "province", "left")
            .select("panoid", F.coalesce("class_idx", F.lit(-1)).alias("class_idx"),
                    F.coalesce("city_idx", F.lit(-1)).alias("city_idx"),
                    F.coalesce("province_idx", F.lit(-1)).alias("province_idx"), "coord_x", "coord_y"))


def vehicle_days(samples: DataFrame, split: DataFrame) -> DataFrame:
    """Training rows per (vehicle, date), personal uploads as an empty vehicle."""
    train = samples.join(split.where(F.col("split") == "train").select("panoid"), "panoid", "left_semi")
    return train.groupBy(sc.vehicle_label("vehicle").alias("vehicle"), F.coalesce("date", F.lit("")).alias("date")).agg(
        F.count("*").alias("n"))


def vehicle_classes(days: DataFrame, min_samples: int = 20, min_dates: int = 2) -> DataFrame:
    """Vehicles with enough training rows on enough days (AGG8).

    ``days`` comes from ``vehicle_days``; counting per day first keeps a hot
    vehicle on many tasks. The vehicles are stored, so the training join behind
    ``days`` runs once. Raises if no vehicle has enough.
    """
    kept = checkpoint(days.where(F.col("vehicle") != "").groupBy("vehicle").agg(
        F.sum("n").alias("n"), F.count("*").alias("dates")).where(
        (F.col("n") >= min_samples) & (F.col("dates") >= min_dates)))
    if kept.isEmpty():
        raise ValueError(f"no vehicle has {min_samples} training rows on {min_dates} days")
    index = (F.row_number().over(W.orderBy("vehicle")) - 1).cast("int")
    return kept.select("vehicle", index.alias("vehicle_idx"), "n", "dates")


def vehicle_label_index(samples: DataFrame, split: DataFrame, min_samples: int = 20, min_dates: int = 2) -> DataFrame:
    """Vehicle, year and prefix labels of every sample, -1 where unknown (AGG8, JN5).

    The (vehicle, date) counts feed all three class spaces and are checkpointed,
    so the training join runs once.
    """
    days = checkpoint(vehicle_days(samples, split))
    vehicles = checkpoint(vehicle_classes(days, min_samples, min_dates).select("vehicle", "vehicle_idx"))
    prefixes = dense_index(vehicles.select(F.substring_index("vehicle", "_", 1).alias("prefix")), "prefix", "prefix_idx")
    years = dense_index(days.select(sc.year_label("date").alias("year")).where(F.col("year") != "unknown"),
                        "year", "year_idx")
    coded = samples.select("panoid", sc.vehicle_label("vehicle").alias("vehicle"), sc.year_label("date").alias("year")
                           ).withColumn("prefix", F.substring_index("vehicle", "_", 1))
    small = fits_broadcast(vehicles)
    return (coded.join(F.broadcast(vehicles) if small else vehicles, "vehicle", "left")
            .join(F.broadcast(years), "year", "left")
            .join(F.broadcast(prefixes) if small else prefixes, "prefix", "left")
            .select("panoid", *[F.coalesce(c, F.lit(-1)).alias(c) for c in ("vehicle_idx", "year_idx", "prefix_idx")]))


def with_classes(df: DataFrame, classes: DataFrame, *fields: str, out: str = "classes") -> DataFrame:
    """Attach the class array as a column; index it with ``F.get`` inside lambdas."""
    return df.withColumn(out, class_array(classes, *fields))


def class_array(classes: DataFrame, *fields: str) -> Column:
    """Class rows as one array ordered by class index, as a scalar subquery.

    The array is a single value that Spark computes once. It is as long as the
    score array of every row beside it, so it adds nothing to what a task holds.
    """
    items = F.sort_array(F.collect_list(F.struct("class_idx", *fields)))
    return classes.agg(items.alias("a")).scalar()


def soft_target_rows(classes: DataFrame, half_km: float = 50.0) -> DataFrame:
    """Soft-label distribution of each class as an array over classes (WIN12, JN10).

    A weight halves every ``half_km``. Each row is built from the centroid array,
    so there is no pairwise join and no shuffle.
    """
    tau = half_km * 1000.0 / math.log(2.0)
    cents = class_array(classes, "lng", "lat")
    raw = F.transform("__cents", lambda c: F.exp(-geo.haversine_m(F.col("lng"), F.col("lat"), c["lng"], c["lat"]) / tau))
    return (classes.select("class_idx", "lng", "lat").withColumn("__cents", cents)
            .select(F.col("class_idx").alias("class_i"), normalize(raw).alias("weights")))


def soft_targets(classes: DataFrame, half_km: float = 50.0) -> DataFrame:
    """Soft labels in long form (class_i, class_j, w) (D10)."""
    rows = soft_target_rows(classes, half_km)
    return rows.select("class_i", F.posexplode("weights").alias("class_j", "w"))


def soft_diagonal(classes: DataFrame, half_km: float = 50.0) -> DataFrame:
    """Median and minimum self weight over the classes (AGG52)."""
    own = soft_target_rows(classes, half_km).select(
        F.element_at("weights", F.col("class_i") + 1).alias("w"))
    return own.agg(F.percentile("w", F.lit(0.5)).alias("median_w"), F.min("w").alias("min_w"))
