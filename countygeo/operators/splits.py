"""Leakage-free splits by (vehicle, day) group, and their checks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from countygeo.functions import scalar as sc
from countygeo.operators.ranking import hash_rank, top_k_per_key
from countygeo.runtime import checkpoint

# Order of the split codes used inside aggregates.
SPLITS = ("train", "val_same", "val_national", "test_county")


def with_group(samples: DataFrame) -> DataFrame:
    """Add the splitting unit of each sample (SC7)."""
    return samples.withColumn("gid", sc.group_key("vehicle", "date", "panoid"))


def group_sizes(samples: DataFrame) -> DataFrame:
    """One row per (group, county): all that splitting needs of the samples.

    Rows collapse on the map side, so a group with a third of all samples is a
    handful of rows after this aggregate.
    """
    return with_group(samples).groupBy("gid", "adcode").agg(
        F.count("*").alias("cnt"), F.min(F.col("part") == sc.OTHER_PART).alias("all_other"))


def eligible_counties(sizes: DataFrame, min_samples: int = 40, focus_prefix: str = sc.FOCUS_PREFIX) -> DataFrame:
    """Focus counties large enough to be held out, with their 0-based position.

    The window runs over counties, of which a six-digit code space has few.
    """
    counties = sizes.where(F.col("adcode").startswith(focus_prefix)).groupBy("adcode").agg(
        F.sum("cnt").alias("n")).where(F.col("n") >= min_samples)
    return counties.select("adcode", (F.row_number().over(W.orderBy("adcode")) - 1).alias("pos"))


def holdout_counties(sizes: DataFrame, holdout: int = 10, min_samples: int = 40,
                     focus_prefix: str = sc.FOCUS_PREFIX) -> DataFrame:
    """Whole counties held out, evenly spaced in code order (WIN5).

    ``sizes`` comes from ``group_sizes``. Raises, when executed, if fewer than
    ``holdout`` counties qualify.
    """
    ranked = eligible_counties(sizes, min_samples, focus_prefix)
    too_few = F.raise_error(F.lit(f"fewer than {holdout} counties have {min_samples} samples"))
    sized = ranked.agg(F.count("*").alias("n"))
    chosen = sized.select(
        F.when(F.col("n") < holdout, too_few.cast("bigint")).otherwise(F.col("n")).alias("n"),
        F.explode(F.sequence(F.lit(0), F.lit(holdout - 1))).alias("i"),
    ).select((F.col("i") * (F.col("n").cast("double") / holdout)).cast("int").alias("pos"))
    return ranked.join(F.broadcast(chosen), "pos").select("adcode")


def assign_groups(sizes: DataFrame, holdout: DataFrame, per_county: int = 15, other_ratio: float = 0.10,
                  seed: int = sc.SEED, focus_prefix: str = sc.FOCUS_PREFIX) -> DataFrame:
    """Split of every group that is not left to training (WIN6, WIN7, WIN7b).

    1. Any member in a held-out county: the whole group is ``test_county``.
    2. Shuffled groups that touch a focus county are ``val_same`` while one of
       their counties is under budget. A county's holding equals the running sum
       over all earlier candidates until its budget is full, so a prefix sum per
       county replaces the loop; only the first ``per_county`` candidates of a
       county can be under budget, so only those are ranked.
    3. A share of the shuffled remaining groups outside the focus part is
       ``val_national``.
    """
    held = checkpoint(holdout.select("adcode", F.lit(True).alias("__held")))
    # A group has at most one row per county here, so this window is small. Four
    # branches read the table, hence the checkpoint.
    whole = W.partitionBy("gid")
    table = checkpoint(sizes.join(F.broadcast(held), "adcode", "left").select(
        "gid", "adcode", "cnt", F.col("adcode").startswith(focus_prefix).alias("focus"),
        F.max(F.coalesce("__held", F.lit(False))).over(whole).alias("held"),
        F.min("all_other").over(whole).alias("all_other")))

    stage1 = table.where("held").select("gid", F.lit("test_county").alias("split")).distinct()

    candidates = table.where(~F.col("held") & ~F.col("all_other") & F.col("focus")).select(
        "gid", "adcode", "cnt", sc.shuffle_key(f"{seed}/same", "gid").alias("__order"))
    first = top_k_per_key(candidates, ["adcode"], ["__order", "gid"], per_county)
    earlier = W.partitionBy("adcode").orderBy("__order", "gid").rowsBetween(W.unboundedPreceding, -1)
    stage2 = (first.withColumn("__before", F.coalesce(F.sum("cnt").over(earlier), F.lit(0)))
              .where(F.col("__before") < per_county).select("gid", F.lit("val_same").alias("split")).distinct())

    rest = table.where(~F.col("held") & F.col("all_other")).select("gid").distinct().select(
        "gid", sc.shuffle_key(f"{seed}/other", "gid").alias("__order"))
    budget = rest.agg(F.floor(F.count("*") * F.lit(other_ratio)).alias("b")).scalar()
    stage3 = hash_rank(rest, "__order", "__rank", tie=["gid"]).where(F.col("__rank") <= budget).select(
        "gid", F.lit("val_national").alias("split"))
    return stage1.unionByName(stage2).unionByName(stage3)


def assign_splits(samples: DataFrame, holdout_n: int = 10, per_county: int = 15, other_ratio: float = 0.10,
                  min_samples: int = 40, seed: int = sc.SEED, focus_prefix: str = sc.FOCUS_PREFIX) -> DataFrame:
    """(panoid, split) for every sample; what no stage takes is ``train``.

    Samples are read twice: once to size the groups, whose table is checkpointed
    because every stage starts from it, and once to join the result back. That
    join has one row per group on the right, so adaptive skew handling can cut a
    hot group on the sample side.
    """
    sizes = checkpoint(group_sizes(samples))
    held = holdout_counties(sizes, holdout_n, min_samples, focus_prefix)
    groups = assign_groups(sizes, held, per_county, other_ratio, seed, focus_prefix)
    return with_group(samples.select("panoid", "vehicle", "date")).join(groups, "gid", "left").select(
        "panoid", F.coalesce("split", F.lit("train")).alias("split"))


def split_counts(split: DataFrame) -> DataFrame:
    """Rows per split (AGG5)."""
    return split.groupBy("split").agg(F.count("*").alias("n"))


def test_counties(samples: DataFrame, split: DataFrame) -> DataFrame:
    """Counties present in the test split (AGG6)."""
    members = split.where(F.col("split") == "test_county").select("panoid")
    return samples.join(members, "panoid", "left_semi").select("adcode").distinct()


def _split_code(split: str = "split"):
    code = F.lit(None).cast("int")
    for i, name in enumerate(SPLITS):
        code = F.when(F.col(split) == name, F.lit(i)).otherwise(code)
    return code


def split_leaks(samples: DataFrame, split: DataFrame) -> DataFrame:
    """Groups with members both in training and in an evaluation split (AGG7)."""
    joined = with_group(samples).join(split, "panoid").withColumn("__code", _split_code())
    return joined.groupBy("gid").agg(F.min("__code").alias("lo"), F.max("__code").alias("hi")).where(
        (F.col("lo") == 0) & (F.col("hi") > 0)).select("gid")


def crossing_groups(samples: DataFrame, split: DataFrame) -> DataFrame:
    """(vehicle, day) groups in more than one split of any kind (CHK1)."""
    named = samples.withColumn("vehicle", F.upper(F.coalesce("vehicle", F.lit("")))).where(
        (F.col("vehicle") != "") & (F.coalesce("date", F.lit("")) != ""))
    joined = named.join(split, "panoid").withColumn("__code", _split_code())
    return joined.groupBy("vehicle", "date").agg(F.min("__code").alias("lo"), F.max("__code").alias("hi")).where(
        F.col("lo") < F.col("hi")).select("vehicle", "date")
