"""Ingest state and packing: pool membership, shards, manifest, reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from countygeo.functions import views as vw
from countygeo.operators.ranking import last_per_key, prefix_sums

STATES = ("pending_meta", "meta_ok", "meta_fail", "done", "fail")


def fold_state(log: DataFrame, key: str = "key") -> DataFrame:
    """Latest row of each key from an append log, all columns (STR1 in batch, WIN18)."""
    return last_per_key(log, [key], ["updated", "event_id"], [c for c in log.columns if c != key])


def in_pool(done: DataFrame, pool: DataFrame) -> DataFrame:
    """Finished rows of this round's pool (JN1)."""
    return done.join(pool.select("panoid"), "panoid", "left_semi")


def not_in_pool(done: DataFrame, pool: DataFrame) -> DataFrame:
    """Finished rows left over from another round (JN2)."""
    return done.join(pool.select("panoid"), "panoid", "left_anti")


def attach_pool(done: DataFrame, pool: DataFrame, columns: tuple[str, ...] = ("lng", "lat", "vehicle", "city")) -> DataFrame:
    """Add pool columns to finished rows, null where absent (JN3)."""
    return done.join(pool.select("panoid", *columns), "panoid", "left")


def insert_new(state: DataFrame, pool: DataFrame, now: Column | None = None, limit: int | None = None,
               part: str | None = None) -> DataFrame:
    """State table with the pool rows that were not in it yet (JN4, FIL10)."""
    fresh = pool if part is None else pool.where(F.col("part") == part)
    if limit:
        fresh = fresh.orderBy("panoid").limit(limit)
    fresh = fresh.join(state.select("panoid"), "panoid", "left_anti").select("panoid", "adcode", "part").withColumns(
        {"state": F.lit("pending_meta"), "updated": now if now is not None else F.current_timestamp()})
    return state.unionByName(fresh, allowMissingColumns=True)


def pending(state: DataFrame, phase: str, part: str | None = None, limit: int | None = None) -> DataFrame:
    """Work of one phase, in id order (FIL10, SRC17)."""
    rows = state.where(F.col("state") == phase)
    if part is not None:
        rows = rows.where(F.col("part") == part)
    rows = rows.orderBy("panoid")
    return rows.limit(limit) if limit else rows


def apply_metadata(pending_rows: DataFrame, answers: DataFrame) -> DataFrame:
    """Outcome of the metadata phase for each pending row (AMJ6, SC25).

    ``answers`` is (panoid, body), the service's JSON. A row without an answer or
    without layers fails; otherwise the layer wanted for its part is chosen.
    """
    meta = answers.select("panoid", vw.service_metadata("body").alias("m"))
    joined = pending_rows.select("panoid", "part").join(meta, "panoid", "left").withColumn(
        "l", vw.pick_layer("m.ImgLayer", vw.tier_of("part") - 1))
    error = F.when(F.col("m").isNull(), "absent").when(F.col("l").isNull(), "no-imglayer")
    ok = F.col("l").isNotNull()
    return joined.select(
        "panoid", F.when(ok, "meta_ok").otherwise("meta_fail").alias("state"), error.alias("error"),
        (F.col("l.level") + 1).alias("tile_z"), F.col("l.bx").alias("block_x"), F.col("l.by").alias("block_y"),
        F.col("m.Date").alias("date"), F.when(ok, F.coalesce("m.Obsolete", F.lit(0))).alias("obsolete"))


def assign_shards(rows: DataFrame, target_bytes: int, size: str = "bytes", order: str = "panoid") -> DataFrame:
    """Shard of each row by its place in the running byte sum (WIN11).

    Shards hold about ``target_bytes`` each, in id order. A row belongs to the
    shard in which it starts, so no state runs across rows; boundaries can differ
    from closing a file at the first row that fills it.
    """
    placed = prefix_sums(rows, [order], {"bytes_before": F.col(size)})
    return placed.withColumn("shard", F.floor(F.col("bytes_before") / F.lit(target_bytes)))


def manifest(sharded: DataFrame, size: str = "bytes") -> DataFrame:
    """Samples and bytes per shard (AGG43)."""
    return sharded.groupBy("shard").agg(F.count("*").alias("samples"), F.sum(size).alias("bytes"))


def state_report(state: DataFrame) -> DataFrame:
    """Rows per state; finished rows, bytes and mean size per part; levels (AGG34).

    One pass over the state table with grouping sets.
    """
    done = F.col("state") == "done"
    narrow = state.select(
        "state", F.when(done, F.col("part")).alias("part"), F.when(done, F.col("tile_z")).alias("tile_z"),
        "bytes", "width", "height")
    grouped = narrow.groupingSets(
        [["state"], ["state", "part"], ["state", "tile_z"]], "state", "part", "tile_z",
    ).agg(F.count("*").alias("n"), F.sum("bytes").alias("bytes"), F.avg("width").alias("width"),
          F.avg("height").alias("height"), F.grouping_id().alias("g"))
    by_state = grouped.where(F.col("g") == 3).select(
        F.lit("state").alias("kind"), F.col("state").alias("name"), "n",
        F.lit(None).cast("bigint").alias("bytes"), F.lit(None).cast("double").alias("width"),
        F.lit(None).cast("double").alias("height"))
    by_part = grouped.where((F.col("g") == 1) & done).select(
        F.lit("part").alias("kind"), F.col("part").alias("name"), "n", "bytes", "width", "height")
    by_level = grouped.where((F.col("g") == 2) & done).select(
        F.lit("level").alias("kind"), F.col("tile_z").cast("string").alias("name"), "n",
        F.lit(None).cast("bigint").alias("bytes"), F.lit(None).cast("double").alias("width"),
        F.lit(None).cast("double").alias("height"))
    return by_state.unionByName(by_part).unionByName(by_level)


def resume_base(state: DataFrame) -> DataFrame:
    """Bytes and rows finished so far; zeros when there are none (AGG35)."""
    return state.where(F.col("state") == "done").agg(
        F.coalesce(F.sum("bytes"), F.lit(0)).alias("bytes"), F.count("*").alias("n"))
