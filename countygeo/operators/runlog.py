"""Training-run logs: recent means, epochs, best checkpoint, digest."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from countygeo.functions.scalar import shuffle_key
from countygeo.operators.ranking import ordered_rank, prefix_sums, rolling_frame, top_k_per_key

RECENT_STEPS = 20


def recent_means(steps: DataFrame, order: Sequence[str], values: dict[str, str], n: int = RECENT_STEPS,
                 keys: Sequence[str] = ()) -> DataFrame:
    """Mean of the last ``n`` steps of each key (WIN14)."""
    return rolling_frame(steps, order, n, {out: F.avg(F.col(c)) for out, c in values.items()}, keys)


def running_mean(steps: DataFrame, order: Sequence[str], value: str, out: str = "running_mean",
                 scale: int = 10**6) -> DataFrame:
    """Mean of all steps up to each one (WIN14).

    Sums are kept in whole units of 1/``scale``, so they do not depend on how the
    steps are partitioned.
    """
    whole = F.round(F.col(value) * scale).cast("bigint")
    sums = prefix_sums(steps, order, {"__s": whole, "__n": F.lit(1)})
    mean = (F.col("__s") + whole).cast("double") / scale / (F.col("__n") + 1)
    return sums.withColumn(out, mean).drop("__s", "__n")


def best_epochs(epochs: DataFrame, metric: str, order: str = "epoch", keys: Sequence[str] = ()) -> DataFrame:
    """Mark epochs that beat every earlier one (WIN15). One row per epoch."""
    before = W.partitionBy(*keys).orderBy(order).rowsBetween(W.unboundedPreceding, -1)
    best = F.max(metric).over(before)
    return epochs.withColumn("is_best", F.col(metric).isNotNull() & (F.col(metric) > F.coalesce(best, F.lit(-1.0))))


def epoch_records(steps: DataFrame, total_epochs: Column | int, batch_size: int = 1) -> DataFrame:
    """Loss, accuracy, time, throughput and time left per epoch (AGG51).

    ``steps`` is (epoch, loss, hits, known, seconds).
    """
    total = total_epochs if isinstance(total_epochs, Column) else F.lit(total_epochs)
    per = steps.groupBy("epoch").agg(
        (F.sum("loss") / F.greatest(F.lit(1), F.count("*"))).alias("train_loss"),
        (F.sum("hits") / F.greatest(F.lit(1), F.sum("known"))).alias("train_acc"),
        F.sum("seconds").alias("__sec"), F.count("*").alias("steps"))
    return per.select(
        "epoch", "train_loss", "train_acc", "steps", F.round(F.col("__sec") / 60, 1).alias("minutes"),
        F.round(F.col("steps") * batch_size / F.greatest("__sec", F.lit(1e-6)), 1).alias("samples_per_sec"),
        ((total - F.col("epoch") - 1) * F.col("__sec") / 60).alias("eta_minutes"))


def log_digest(epochs: DataFrame, columns: Sequence[str], n: int = 5) -> DataFrame:
    """Last ``n`` epochs of a run log, chosen columns (AGG50, SRC16)."""
    return epochs.orderBy(F.desc("epoch")).limit(n).select("epoch", *columns)


def strided_part(keys: DataFrame, key: str, world: int) -> DataFrame:
    """Exact strided partition of sorted keys: row i goes to rank i mod world (WIN16)."""
    return ordered_rank(keys, [key], "__r").withColumn("part", ((F.col("__r") - 1) % world).cast("int")).drop("__r")


def spot_checks(keys: DataFrame, key: str, pieces: int = 12) -> DataFrame:
    """Every (n / pieces)-th key of the sorted list (FIL9)."""
    ranked = ordered_rank(keys.select(key), [key], "__r")
    step = keys.agg(F.greatest(F.lit(1), F.floor(F.count("*") / pieces)).alias("s")).scalar()
    return ranked.where((F.col("__r") - 1) % step == 0).select(key)


def uniform_sample(df: DataFrame, key: str, n: int, strata: Sequence[str], seed: int) -> DataFrame:
    """Uniform sample of ``n`` rows per stratum (FIL8)."""
    keyed = df.withColumn("__draw", shuffle_key(seed, key))
    return top_k_per_key(keyed, list(strata), ["__draw", key], n).drop("__draw")


def stratified_subset(df: DataFrame, key: str, stratum: str, n: int, seed: int = 0) -> DataFrame:
    """``n`` rows taken in turn from shuffled strata (WIN13).

    Nothing beyond the n-th row of a stratum can be taken, so strata are cut there
    before the overall top-n.
    """
    keyed = df.withColumn("__draw", shuffle_key(seed, key))
    ranked = top_k_per_key(keyed, [stratum], ["__draw", key], n, rank="__turn")
    return ranked.orderBy("__turn", stratum).limit(n).drop("__draw", "__turn")
