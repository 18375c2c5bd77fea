"""Structured Streaming forms of the incremental jobs.

Every job takes a streaming DataFrame and returns a configured writer or a
streaming DataFrame; ``run_available`` drains the input once, as tests and
scheduled jobs do.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from countygeo.functions import geo
from countygeo.functions import scalar as sc
from countygeo.operators.sampling import reservoir
from countygeo.runtime import remove, scratch_path

PROGRESS_WINDOW = "15 seconds"
LATE = "10 minutes"


def latest_state(stream: DataFrame, key: str = "key", order: Sequence[str] = ("updated", "event_id")) -> DataFrame:
    """Newest row per key under ``order``, all columns; rows out of order cannot set it back (STR1, STR7)."""
    rest = [c for c in stream.columns if c != key]
    best = F.max_by(F.struct(*rest), F.struct(*order))
    return stream.groupBy(key).agg(best.alias("s")).select(key, "s.*")


def first_insert(stream: DataFrame, key: str = "key", delay: str = LATE, keep: str = LATE) -> DataFrame:
    """First row of each key wins, until the key has been silent for ``keep`` (STR2).

    The winner is the least (updated, event_id), whatever the order of arrival
    within ``delay``. A key that returns after ``keep`` is inserted anew, so state
    is bounded by the keys of that time. Append mode: a winner is sent once its
    key can no longer have an earlier row.
    """
    best = F.min_by(F.struct("*"), F.struct("updated", "event_id"))
    return stream.withWatermark("updated", delay).groupBy(F.session_window("updated", keep).alias("w"), key).agg(best.alias("r")).select("r.*")


def progress(stream: DataFrame, delay: str = LATE, window: str = PROGRESS_WINDOW) -> DataFrame:
    """Finished and failed rows and the rate per time window (STR3).

    For append mode: a window is sent, and its state dropped, when the watermark
    (newest time less ``delay``) has passed its end; later rows of it are dropped.
    """
    seconds = float(window.split()[0])
    per = stream.withWatermark("updated", delay).groupBy(F.window("updated", window).alias("w")).agg(
        F.count("*").alias("n"), F.count_if(F.col("state") == "done").alias("ok"),
        F.count_if(F.col("state").isin("fail", "meta_fail")).alias("failed"))
    return per.select(F.col("w.start").alias("start"), "n", "ok", "failed", (F.col("n") / seconds).alias("rate"))


def remaining_minutes(left: Column, rate: Column) -> Column:
    """Minutes until ``left`` rows are done at ``rate`` rows per second (STR3)."""
    return F.when(rate > 0, left / rate / 60).otherwise(F.lit(0.0))


def thin_first(stream: DataFrame, size_m: float = sc.SAMPLE_GRID_M, order: Sequence[str] = ("panoid",)) -> DataFrame:
    """First row per county cell under ``order`` (STR4); state is bounded by the cells.

    For update mode: the last row sent for a cell is its first row so far, the
    same however the rows are spread over batches.
    """
    cells = stream.withColumns({"gx": geo.grid_x("lng", "lat", size_m), "gy": geo.grid_y("lat", size_m)})
    rest = [c for c in stream.columns if c != "adcode"]
    best = F.min_by(F.struct(*rest), F.struct(*order))
    return cells.groupBy("adcode", "gx", "gy").agg(best.alias("s")).select("adcode", "gx", "gy", "s.*")


def county_counts(stream: DataFrame) -> DataFrame:
    """Running rows per county and province (STR6)."""
    return stream.groupBy("adcode", sc.province_code("adcode", on_short="null").alias("province")).count()


def step_means(stream: DataFrame, delay: str = LATE, window: str = "20 minutes", slide: str = "5 minutes") -> DataFrame:
    """Mean of a step value over a sliding time window, sent in append mode when it is closed (STR8)."""
    return stream.withWatermark("updated", delay).groupBy(F.window("updated", window, slide).alias("w")).agg(
        F.avg("value").alias("mean"), F.count("*").alias("n")).select(F.col("w.start").alias("start"), "mean", "n")


def passes(stream: DataFrame, time: str = "day", delay: str = "1 day") -> DataFrame:
    """Rows of each vehicle and day (STR10), sent in append mode when the day is closed."""
    return (stream.withWatermark(time, delay).groupBy(F.window(time, "1 day").alias("w"), "vehicle").agg(F.count("*").alias("count"))
            .select("vehicle", F.col("w.start").alias("day"), "count"))


def sessions(stream: DataFrame, key: str = "key", gap: str = "30 minutes", delay: str = LATE) -> DataFrame:
    """Gap-based variant of ``passes`` (STR10), sent in append mode when the gap has passed.

    A row out of order, but within ``delay``, can extend a session or join two.
    """
    return stream.withWatermark("updated", delay).groupBy(F.session_window("updated", gap).alias("w"), key).agg(
        F.count("*").alias("n")).select(key, F.col("w.start").alias("start"), "n")


# --------------------------------------------------------------------------
# Running
# --------------------------------------------------------------------------

def run_available(stream: DataFrame, sink: Callable[[DataFrame, int], None], mode: str, checkpoint: str) -> StreamingQuery:
    """Process everything that is there, then stop (STR9).

    Offsets and state live in ``checkpoint``; calling again continues from there.
    """
    query = (stream.writeStream.outputMode(mode).option("checkpointLocation", checkpoint)
             .trigger(availableNow=True).foreachBatch(sink).start())
    query.awaitTermination()
    return query


def table_sink(path: str) -> Callable[[DataFrame, int], None]:
    """Sink with one folder per batch: a replayed batch replaces itself."""
    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    return write


def latest_sink(path: str, key: str = "key", order: Sequence[str] = ("updated", "event_id")) -> Callable[[DataFrame, int], None]:
    """Sink with one folder per batch that holds the newest row of each key in it (STR7).

    For append mode: what a key had in earlier batches stays in their folders, so no
    state of all keys is held in memory; ``read_latest`` takes the newest over them.
    """
    write = table_sink(path)
    return lambda batch, batch_id: write(latest_state(batch, key, order), batch_id)


def read_latest(spark: SparkSession, path: str, schema: StructType, key: str = "key", order: Sequence[str] = ("updated", "event_id")) -> DataFrame:
    """Newest row of each key over the batches of a ``latest_sink``."""
    return latest_state(read_sink(spark, path, schema).drop("batch"), key, order)


def read_sink(spark: SparkSession, path: str, schema) -> DataFrame:
    """All batches of a ``table_sink`` with their number."""
    return spark.read.schema(schema).option("basePath", path).parquet(f"{path}/batch=*").withColumn(
        "batch", F.regexp_extract(F.input_file_name(), r"batch=(\d+)", 1).cast("bigint"))


def newest_rows(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Last update of each key over the batches of an update-mode sink."""
    rest = [c for c in rows.columns if c not in (*keys, "batch")]
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), "batch").alias("r")).select(*keys, "r.*")


def last_batch(rows: DataFrame) -> DataFrame:
    """Result of a complete-mode sink: its last batch."""
    newest = rows.agg(F.max("batch")).scalar()
    return rows.where(F.col("batch") == newest).drop("batch")


def committed(spark: SparkSession, checkpoint: str) -> int | None:
    """Number of the last finished batch in a checkpoint folder; None before the first."""
    try:
        names = spark.read.text(f"{checkpoint}/commits").select(F.regexp_extract(F.input_file_name(), r"/(\d+)$", 1).alias("name"))
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return None
    return names.where("name <> ''").agg(F.max(F.col("name").cast("bigint"))).first()[0]


def reservoir_sink(path: str, **quotas: int) -> Callable[[DataFrame, int], None]:
    """Sink that merges each batch into the sample before it (STR5).

    The sample is a bottom-k of row hashes, so the kept rows and a new batch, cut
    again, equal a sample of everything. Version ``v=N`` is the sample after
    batch N. A replayed batch starts from the same version and replaces its own;
    versions that no replay can need are removed.
    """
    def merge(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        kept = batch
        if batch_id > 0:
            kept = spark.read.schema(batch.schema).parquet(f"{path}/v={batch_id - 1}").unionByName(batch)
        reservoir(kept, **quotas).write.mode("overwrite").parquet(f"{path}/v={batch_id}")
        remove(spark, f"{path}/v={batch_id - 2}")

    return merge


def reservoir_of(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """The sample as of the last finished batch; empty before the first."""
    last = committed(spark, f"{path}/checkpoint")
    return spark.createDataFrame([], schema) if last is None else spark.read.schema(schema).parquet(f"{path}/v={last}")


def streamed_reservoir(stream: DataFrame, path: str, **quotas: int) -> DataFrame:
    """Take what is new in ``stream`` into the sample kept in ``path``, and return the sample (STR5).

    Offsets, batch numbers and versions are all in ``path``: another session that
    calls it with the same folder goes on where the last one ended.
    """
    run_available(stream, reservoir_sink(path, **quotas), "append", f"{path}/checkpoint")
    return reservoir_of(stream.sparkSession, path, stream.schema)
