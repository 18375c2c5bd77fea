"""Distributed ranking: top-k per key, global ranks, prefix sums, exact quantiles.

A plain window sends every row of a key to one task. None of the helpers here
do: each bounds what a task sees even when one key holds a third of the table.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from countygeo.runtime import broadcast_if_small, checkpoint

# Rows of a block in block-wise windows; the halo of a frame is added on top.
BLOCK_ROWS = 65_536
# Rows of a range in prefix sums.
RANGE_ROWS = 250_000
# Hash-ordered ranking counts rows per prefix of this many hex digits (65,536 buckets).
HASH_DIGITS = 4


def _order(order: Sequence[Column | str]) -> list[Column]:
    return [F.col(c) if isinstance(c, str) else c for c in order]


def top_k_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[Column | str], k: int | Column,
                  k_max: int | None = None, fan_in: int = 256, rank: str | None = None) -> DataFrame:
    """First ``k`` rows of each key under ``order``; exact, in two rounds.

    Round one ranks inside (key, source partition mod ``fan_in``), so the rows of
    a hot key are spread over ``fan_in`` tasks and Spark's window group limit has
    already cut each map task to ``k`` rows per key. Round two ranks the at most
    ``fan_in * k`` survivors. Top-k of a union of top-k lists is the top-k, so no
    row is lost. ``k`` may be a per-row column bounded by ``k_max``.
    """
    limit = k if isinstance(k, int) else k_max
    if limit is None:
        raise ValueError("k_max is needed when k is a column")
    name = rank or "__rank"
    by = _order(order)
    spread = df.withColumn("__lane", F.spark_partition_id() % F.lit(fan_in))
    first = W.partitionBy(*keys, "__lane").orderBy(*by)
    local = spread.withColumn("__local", F.row_number().over(first)).where(F.col("__local") <= limit)
    final = W.partitionBy(*keys).orderBy(*by)
    out = local.drop("__lane", "__local").withColumn(name, F.row_number().over(final)).where(F.col(name) <= limit)
    if not isinstance(k, int):
        out = out.where(F.col(name) <= k)
    return out if rank else out.drop(name)


def first_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[str], values: Sequence[str]) -> DataFrame:
    """One row per key, the first under ``order``.

    A plain aggregate: copies are combined on the map side, so a key with a
    third of the rows costs one row per map task.
    """
    best = F.min_by(F.struct(*values), F.struct(*order))
    return df.groupBy(*keys).agg(best.alias("__best")).select(*keys, "__best.*")


def last_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[str], values: Sequence[str]) -> DataFrame:
    """One row per key, the last under ``order`` (last write wins, WIN18)."""
    best = F.max_by(F.struct(*values), F.struct(*order))
    return df.groupBy(*keys).agg(best.alias("__best")).select(*keys, "__best.*")


def hash_rank(df: DataFrame, digest: str, rank: str = "rank", tie: Sequence[str] = ()) -> DataFrame:
    """Global 1-based rank by a hex digest column, without a global window.

    Digests are uniform, so their first digits split the rows into even buckets:
    rank = rows in earlier buckets + rank inside the bucket. The table of bucket
    counts has at most 16**HASH_DIGITS rows whatever the input.
    """
    bucketed = df.withColumn("__bucket", F.substring(digest, 1, HASH_DIGITS))
    counts = bucketed.groupBy("__bucket").agg(F.count("*").alias("__n"))
    before = W.orderBy("__bucket").rowsBetween(W.unboundedPreceding, -1)
    offsets = counts.select("__bucket", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__before"))
    inside = W.partitionBy("__bucket").orderBy(digest, *tie)
    return (
        bucketed.withColumn("__inside", F.row_number().over(inside))
        .join(F.broadcast(offsets), "__bucket")
        .withColumn(rank, F.col("__before") + F.col("__inside"))
        .drop("__bucket", "__inside", "__before")
    )


def _running(names: Sequence[str], columns: Sequence[str]):
    """Adds the number of the range and, for each name, the sum over the rows of the range before each one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        carry = dict.fromkeys(names, 0)
        for batch in batches:
            before = []
            for name in names:
                value = batch.column(f"__v_{name}").to_numpy()
                upto = np.cumsum(value) + carry[name]
                before.append(pa.array(upto - value))
                carry[name] = int(upto[-1]) if len(upto) else carry[name]
            yield pa.RecordBatch.from_arrays(
                [*[batch.column(c) for c in columns], pa.array(np.full(batch.num_rows, part, dtype=np.int32)), *before,
                 *[batch.column(f"__v_{n}") for n in names]],
                [*columns, "__part", *[f"__b_{n}" for n in names], *[f"__v_{n}" for n in names]])

    return run


def prefix_sums(df: DataFrame, order: Sequence[str], sums: dict[str, Column], range_rows: int = RANGE_ROWS) -> DataFrame:
    """Running totals *before* each row in the order of a unique key.

    A scan on two levels. Rows are dealt to ranges of about ``range_rows`` each,
    whatever the session's number of shuffle partitions, at split points that
    Spark samples from the key; skewed keys get narrower ranges. A task walks its
    sorted range in batches that carry the sums on, and the result is stored.
    Then the totals of the ranges, one row each, are accumulated and joined back.
    Rows are shuffled once.
    """
    names, columns = list(sums), [c for c in df.columns if c not in sums]
    valued = df.select(*columns, *[F.coalesce(value.cast("bigint"), F.lit(0)).alias(f"__v_{n}") for n, value in sums.items()])
    ranges = max(1, -(-df.count() // range_rows))
    schema = ", ".join([*[f"`{c}` {df.schema[c].dataType.simpleString()}" for c in columns], "__part int",
                        *[f"`__b_{n}` bigint" for n in names], *[f"`__v_{n}` bigint" for n in names]])
    fixed = checkpoint(valued.repartitionByRange(ranges, *order).sortWithinPartitions(*order).mapInArrow(_running(names, columns), schema))
    totals = fixed.groupBy("__part").agg(*[F.sum(f"__v_{n}").alias(f"__t_{n}") for n in names])
    earlier = W.orderBy("__part").rowsBetween(W.unboundedPreceding, -1)
    offsets = totals.select("__part", *[F.coalesce(F.sum(f"__t_{n}").over(earlier), F.lit(0)).alias(f"__o_{n}") for n in names])
    return fixed.join(broadcast_if_small(offsets), "__part").select(
        *columns, *[(F.col(f"__b_{n}") + F.col(f"__o_{n}")).alias(n) for n in names])


def ordered_rank(df: DataFrame, order: Sequence[str], rank: str = "rank", range_rows: int = RANGE_ROWS) -> DataFrame:
    """Global 1-based row number in the order of a unique key."""
    out = prefix_sums(df, order, {rank: F.lit(1)}, range_rows)
    return out.withColumn(rank, F.col(rank) + 1)


def rolling_frame(df: DataFrame, order: Sequence[str], n: int, aggs: dict[str, Column],
                  keys: Sequence[str] = (), block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Aggregates over the last ``n`` rows of each key, without one task per key.

    The rows get a global rank and are cut into blocks; the last ``n - 1`` rows of
    a block are copied into the next one as context and dropped afterwards.
    """
    if n - 1 > block_rows:
        raise ValueError("block_rows must be at least the frame length")
    ranked = ordered_rank(df, [*keys, *order], "__rank").withColumn("__rank", F.col("__rank") - 1)
    home = F.floor(F.col("__rank") / block_rows)
    tail = F.col("__rank") % block_rows >= block_rows - (n - 1)
    blocks = F.when(tail, F.array(home, home + 1)).otherwise(F.array(home)) if n > 1 else F.array(home)
    spread = ranked.withColumn("__home", home).withColumn("__block", F.explode(blocks))
    frame = W.partitionBy("__block", *keys).orderBy("__rank").rowsBetween(-(n - 1), 0)
    out = spread.withColumns({name: agg.over(frame) for name, agg in aggs.items()})
    return out.where(F.col("__block") == F.col("__home")).drop("__rank", "__home", "__block")


def order_statistics(df: DataFrame, keys: Sequence[str], value: str, picks: dict[str, Column],
                     width: float = 1.0, size: str | None = None) -> DataFrame:
    """Exact order statistics of a non-negative value, one row per key; NaN raises.

    ``picks`` maps an output name to a 0-based rank written over ``n``, the
    number of rows of the key; ``size`` names a column for it. Two histograms,
    combined on the map side, locate each rank: buckets of ``width``, and
    1/65,536 of that inside the bucket that holds it. Only rows of that fine
    bucket are counted by value and ordered, so the input itself is never
    shuffled. Every window runs over a bounded histogram, never over the rows of
    a key. Keys and values are checkpointed, so the input is computed once.
    """
    keys = list(keys)
    number = F.col(value).cast("double")
    no_order = F.raise_error(F.lit(f"{value} has a NaN, which has no place in an order")).cast("double")
    keyed = df.where(F.col(value).isNotNull()).select(
        *keys, F.lit(0).alias("__all"), F.when(F.isnan(number), no_order).otherwise(number).alias("__v"))
    group = [*keys, "__all"]
    fine = 65_536
    rows = checkpoint(keyed.withColumns({
        "__b1": F.floor(F.col("__v") / width),
        "__b2": F.floor((F.col("__v") / width - F.floor(F.col("__v") / width)) * fine),
    }))

    def running(frame: DataFrame, within: list[str], by: str, base: Column) -> DataFrame:
        before = W.partitionBy(*within).orderBy(by).rowsBetween(W.unboundedPreceding, -1)
        low = base + F.coalesce(F.sum("__c").over(before), F.lit(0))
        return frame.withColumn("__lo", low).withColumn("__hi", F.col("__lo") + F.col("__c"))

    hist1 = rows.groupBy(*group, "__b1").agg(F.count("*").alias("__c"))
    sized = hist1.withColumn("n", F.sum("__c").over(W.partitionBy(*group)))
    wanted = F.explode(F.array(*[
        F.struct(F.lit(name).alias("name"), rank.cast("bigint").alias("r")) for name, rank in picks.items()]))
    inside = (F.col("__p.r") >= F.col("__lo")) & (F.col("__p.r") < F.col("__hi"))
    hit1 = running(sized, group, "__b1", F.lit(0)).withColumn("__p", wanted).where(inside)
    coarse = hit1.groupBy(*group, "__b1").agg(
        F.first("__lo").alias("__base1"), F.first("n").alias("n"), F.collect_set("__p").alias("__want"))

    within = [*group, "__b1"]
    narrowed = rows.join(coarse.select(*within), within, "left_semi")
    hist2 = narrowed.groupBy(*within, "__b2").agg(F.count("*").alias("__c")).join(coarse, within)
    hit2 = running(hist2, [*group, "__b1"], "__b2", F.col("__base1")).withColumn("__p", F.explode("__want")).where(inside)
    exact = hit2.groupBy(*group, "__b1", "__b2").agg(
        F.first("__lo").alias("__base2"), F.first("n").alias("n"), F.collect_set("__p").alias("__want2"))

    place = [*within, "__b2"]
    values = (rows.join(exact.select(*place), place, "left_semi").groupBy(*place, "__v")
              .agg(F.count("*").alias("__c")).join(exact, place))
    hit3 = running(values, place, "__v", F.col("__base2")).withColumn(
        "__p", F.explode("__want2")).where(inside)
    return hit3.groupBy(*group).agg(*[
        F.max(F.when(F.col("__p.name") == name, F.col("__v"))).alias(name) for name in picks],
        *([F.first("n").alias(size)] if size else [])).drop("__all")


def picked_quantiles(df: DataFrame, keys: Sequence[str], value: str, percents: dict[str, int],
                     width: float = 1.0) -> DataFrame:
    """Index-picked quantiles: the value at ``min(n - 1, n * q // 100)`` (AGG24)."""
    n = F.col("n")
    picks = {name: F.least(n - 1, F.floor(n * q / 100.0)) for name, q in percents.items()}
    return order_statistics(df, keys, value, picks, width)


def linear_quantiles(df: DataFrame, keys: Sequence[str], value: str, probs: dict[str, float],
                     width: float = 1.0) -> DataFrame:
    """Linearly interpolated quantiles (AGG17), exact."""
    n = F.col("n")
    picks: dict[str, Column] = {}
    for name, p in probs.items():
        at = (n - 1) * F.lit(p)
        picks[f"__{name}_lo"] = F.floor(at)
        picks[f"__{name}_hi"] = F.ceil(at)
        if not (0.0 <= p <= 1.0 and math.isfinite(p)):
            raise ValueError("probabilities must be in [0, 1]")
    out = order_statistics(df, keys, value, picks, width, size="n")
    for name, p in probs.items():
        at = (n - 1) * F.lit(p)
        low, high = F.col(f"__{name}_lo"), F.col(f"__{name}_hi")
        out = out.withColumn(name, low + (high - low) * (at - F.floor(at)))
    return out.select(*keys, *probs)
