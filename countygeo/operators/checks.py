"""Integrity checks and set operations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from countygeo.functions.scalar import is_panorama
from countygeo.operators.splits import crossing_groups


def duplicates(df: DataFrame, key: str) -> DataFrame:
    """Keys that occur more than once (CHK2, CHK3)."""
    return df.groupBy(key).agg(F.count("*").alias("n")).where(F.col("n") > 1)


def key_differences(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Keys present on one side only (SET1).

    One aggregation over the union: copies of a key collapse before the shuffle.
    """
    both = left.select(key, F.lit(1).alias("l"), F.lit(0).alias("r")).unionByName(
        right.select(key, F.lit(0).alias("l"), F.lit(1).alias("r")))
    return both.groupBy(key).agg(F.max("l").alias("l"), F.max("r").alias("r")).where(
        F.col("l") + F.col("r") < 2).select(
        key, F.when(F.col("l") == 1, F.lit("left only")).otherwise(F.lit("right only")).alias("side"))


def missing_keys(wanted: DataFrame, present: DataFrame, key: str) -> DataFrame:
    """Wanted keys that are absent, for example samples without an image (SET2)."""
    return wanted.select(key).distinct().join(present.select(key), key, "left_anti")


def cached_keys(known: DataFrame, wanted: DataFrame, key: str) -> DataFrame:
    """Keys that are both known and wanted (SET5)."""
    return known.select(key).intersect(wanted.select(key))


def pending_work(positions: DataFrame, fetched: DataFrame, images: DataFrame, key: str) -> DataFrame:
    """Positions not fetched successfully or without an image (FIL7)."""
    ok = fetched.where("ok").select(key, F.lit(True).alias("__ok"))
    img = images.select(key).distinct().withColumn("__img", F.lit(True))
    return positions.join(ok, key, "left").join(img, key, "left").where(
        F.col("__ok").isNull() | F.col("__img").isNull()).drop("__ok", "__img")


def split_members(samples: DataFrame, split: DataFrame, name: str, required: bool = True) -> DataFrame:
    """Samples of one split, sorted by id; a split without members raises (FIL2), unless it is not ``required``."""
    members = split.where(F.col("split") == name).select("panoid")
    if required and members.isEmpty():
        raise ValueError(f"nothing is assigned to split {name!r}")
    return samples.join(members, "panoid", "left_semi").orderBy("panoid")


def untrained_counties(samples: DataFrame, split: DataFrame, holdout: DataFrame) -> DataFrame:
    """Counties without training rows, held out on purpose or not (SET4)."""
    train = samples.join(split.where(F.col("split") == "train").select("panoid"), "panoid", "left_semi")
    bare = samples.select("adcode").distinct().join(train.select("adcode").distinct(), "adcode", "left_anti")
    marked = holdout.select("adcode", F.lit(True).alias("__h"))
    return bare.join(F.broadcast(marked), "adcode", "left").select(
        "adcode", F.coalesce("__h", F.lit(False)).alias("intended"))


def class_profile(samples: DataFrame, split: DataFrame) -> DataFrame:
    """Training counties: how many, how many large, how many small (AGG9)."""
    train = samples.join(split.where(F.col("split") == "train").select("panoid"), "panoid", "left_semi")
    return train.groupBy("adcode").agg(F.count("*").alias("n")).agg(
        F.count("*").alias("counties"), F.count_if(F.col("n") >= 100).alias("at_least_100"),
        F.count_if(F.col("n") < 10).alias("under_10"))


def unsupported_vehicles(classes: DataFrame, coverage: DataFrame) -> DataFrame:
    """Vehicle classes that no trajectory covers (SET7)."""
    return classes.select("vehicle").join(
        coverage.select(F.upper("vehicle").alias("vehicle")).distinct(), "vehicle", "left_anti")


def preflight(samples: DataFrame, split: DataFrame, images: DataFrame | None = None) -> DataFrame:
    """One-row integrity report; every problem count must be zero (CHK1-CHK4).

    ``untrained`` lists counties without training rows. Where samples have a
    width and height, all of them are tested for 2:1, not a few.
    """
    sized = {"width", "height"} <= set(samples.columns)
    flat = ~is_panorama("width", "height", None) if sized else F.lit(False)
    joined = samples.select("panoid", "adcode", flat.alias("__flat")).join(split, "panoid", "left")
    per = joined.groupBy("adcode").agg(
        F.count("*").alias("n"), *[F.count_if(F.col("split") == s).alias(s)
                                   for s in ("train", "val_same", "val_national", "test_county")],
        F.count_if("__flat").alias("flat"))
    has_train = F.col("train") > 0
    base = per.agg(
        F.sum("n").alias("samples"),
        *[F.sum(s).alias(s) for s in ("train", "val_same", "val_national", "test_county")],
        F.count_if(has_train).alias("train_counties"), F.count_if(~has_train).alias("untrained_counties"),
        F.count_if(has_train & (F.col("train") < 10)).alias("train_counties_under_10"),
        F.array_sort(F.collect_list(F.when(~has_train, F.col("adcode")))).alias("untrained"),
        *([F.sum("flat").alias("not_two_to_one")] if sized else []))
    problems = {
        "duplicate_ids": duplicates(samples, "panoid"),
        "key_differences": key_differences(samples, split, "panoid"),
        "crossing_groups": crossing_groups(samples, split),
    }
    if images is not None:
        problems["missing_images"] = missing_keys(samples, images, "panoid")
        problems["duplicate_images"] = duplicates(images, "panoid")
    for name, frame in problems.items():
        base = base.withColumn(name, frame.agg(F.count("*").alias("n")).scalar())
    return base


def metadata_diff(old: DataFrame, new: DataFrame) -> DataFrame:
    """Names whose values differ between two one-row tables (CHK5)."""
    def tall(df: DataFrame, out: str) -> DataFrame:
        pairs = [F.struct(F.lit(c).alias("name"), F.col(c).cast("string").alias(out)) for c in df.columns]
        return df.select(F.inline(F.array(*pairs)))

    return tall(old, "old").join(tall(new, "new"), "name", "full").where(
        ~F.col("old").eqNullSafe(F.col("new")))


def require_empty(problems: DataFrame, message: str) -> None:
    """Raise if a check found anything; looks at one row only."""
    first = problems.take(1)
    if first:
        raise ValueError(f"{message}: {first[0].asDict()}")
