"""Session helpers: reliable checkpoints and size checks."""

from __future__ import annotations

import re
import tempfile
import uuid
from urllib.parse import quote

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Largest side, in rows, that is ever sent whole to every executor.
BROADCAST_ROWS = 2_000_000


def shared_dir(spark: SparkSession) -> str:
    """Folder for intermediate tables: the cluster's own, if it names one.

    Only a session in one process (a local test) without ``spark.checkpoint.dir``
    gets a temporary folder. Elsewhere that raises: executors would write to
    their own disks and later reads would miss rows.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured.rstrip("/")
    require_one_process(spark.sparkContext.master)
    made = spark.conf.get("countygeo.local.dir", None)
    if not made:
        made = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
        spark.conf.set("countygeo.local.dir", made)
    return made


def require_one_process(master: str) -> None:
    """Raise unless ``master`` runs driver and tasks in one process."""
    if not re.fullmatch(r"local(\[[^\]]*\])?", master):
        raise RuntimeError(f"set spark.checkpoint.dir to a folder that all executors share; master is {master}")


def scratch_path(spark: SparkSession, name: str) -> str:
    """Fresh path below the shared folder."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def remove(spark: SparkSession, path: str) -> None:
    """Delete a file or folder of any file system Spark knows; nothing happens if it is not there."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(target, True)


def arrow_uri(spark: SparkSession, folder: str) -> tuple[str, str]:
    """A folder by its full name, as Spark gives it, and as a URI that Arrow opens in the tasks."""
    target = spark._jvm.org.apache.hadoop.fs.Path(folder)
    where = target.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).makeQualified(target)
    parts = where.toUri()
    return where.toString(), f"{parts.getScheme()}://{parts.getAuthority() or ''}{quote(parts.getPath())}"


def checkpoint(df: DataFrame) -> DataFrame:
    """``df`` computed once and cut off from its lineage.

    A table in the shared folder: it survives lost executors, is written in one
    pass, and later reads prune columns and push filters into it.
    """
    spark = df.sparkSession
    path = scratch_path(spark, "table")
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def spread(df: DataFrame, key: str) -> DataFrame:
    """Deal a table of few input splits, or of one that holds most rows, over the cores; others stay as they are.

    A small file, or a large one that was written as a single row group, would
    otherwise keep all row-wise work in one task. Rows of the splits are counted
    without reading a column.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    splits = df.rdd.getNumPartitions()
    if 2 * splits > cores:
        sizes = df.groupBy(F.spark_partition_id()).count()
        largest, rows = sizes.agg(F.max("count"), F.sum("count")).first()
        if not rows or largest * cores <= 2 * rows:
            return df
    return df.repartition(max(cores, splits), key)


def fits_broadcast(df: DataFrame, limit: int = BROADCAST_ROWS) -> bool:
    """Whether ``df`` has at most ``limit`` rows; stops counting just beyond it."""
    return df.limit(limit + 1).count() <= limit


def broadcast_if_small(df: DataFrame, limit: int = BROADCAST_ROWS) -> DataFrame:
    """``df`` computed once, with a broadcast hint if it has few rows.

    A larger table keeps the shuffled join.
    """
    table = checkpoint(df)
    return F.broadcast(table) if fits_broadcast(table, limit) else table
