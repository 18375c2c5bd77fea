"""Shards of near equal bytes for indivisible groups of copies, by Karmarkar-Karp differencing (operator 11)."""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from countygeo.runtime import broadcast_if_small, checkpoint

SHARDS = 24
# Bytes that a row costs beside its text.
ROW_BYTES = 8
# Units that are dealt to shards, at most. A unit is every group whose text hash leaves the same remainder.
UNITS = 65_536


def differencing(sizes: list[int], shards: int) -> np.ndarray:
    """Shard of each size, so that the sums of the shards are nearly equal.

    A size alone is a partial partition with one part filled. The two partial
    partitions of largest spread (fullest less emptiest part) are combined, the
    fullest part of one with the emptiest of the other, until one is left; ties
    go to the older one. Parts are kept in falling order of their sums, and only
    the permutations are stored: shards are read from them on the way back.
    """
    n = len(sizes)
    shard = np.zeros(n, dtype=np.int64)
    if n == 0:
        return shard
    sums = {}
    for k, size in enumerate(sizes):
        sums[k] = np.zeros(shards, dtype=np.int64)
        sums[k][0] = size
    heap = [(-int(x[0] - x[-1]), k) for k, x in sums.items()]
    heapq.heapify(heap)
    merges = []
    while len(heap) > 1:
        a, b = heapq.heappop(heap)[1], heapq.heappop(heap)[1]
        total = sums.pop(a) + sums.pop(b)[::-1]
        order = np.argsort(-total, kind="stable")
        made = n + len(merges)
        sums[made] = total[order]
        merges.append((a, b, order))
        heapq.heappush(heap, (-int(sums[made][0] - sums[made][-1]), made))
    labels = {heap[0][1]: np.arange(shards)}
    for made in range(n + len(merges) - 1, n - 1, -1):
        a, b, order = merges[made - n]
        label = np.empty(shards, dtype=np.int64)
        label[order] = labels.pop(made)
        labels[a], labels[b] = label, label[::-1]
    for k in range(n):
        shard[k] = labels[k][0]
    return shard


def _number(shard_of: np.ndarray, shards: int, columns: list[str]):
    """Adds shard, the task that numbered the row, and its place among the task's rows of that shard."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get().partitionId()
        seen = np.zeros(shards, dtype=np.int64)
        for batch in batches:
            shard = shard_of[batch.column("unit").to_numpy()]
            order = np.argsort(shard, kind="stable")
            count = np.bincount(shard, minlength=shards)
            rank = np.empty(len(shard), dtype=np.int64)
            rank[order] = np.arange(len(shard)) - np.repeat(np.cumsum(count) - count, count) + np.repeat(seen, count)
            seen += count
            yield pa.RecordBatch.from_arrays(
                [*[batch.column(c) for c in columns], pa.array(shard, pa.int32()),
                 pa.array(np.full(len(shard), task, dtype=np.int32)), pa.array(rank)], [*columns, "shard", "task", "rank"])

    return run


def shard_documents(documents: DataFrame, doc_id: str = "doc_id", text: str = "text", shards: int = SHARDS,
                    units: int = UNITS, keep_text: bool = False) -> DataFrame:
    """Each row's size, text_crc32, shard and slot (and its text, if wanted): rows of equal text share a shard.

    The size is the UTF-8 bytes of the text plus 8. Groups of equal texts are
    gathered in ``units`` by a hash of their text, with a sum that tasks combine
    before the shuffle: ``units`` sums at most reach the driver, however many
    rows there are and however many of them are copies. Differencing deals the
    units to shards. No group is ever split, so a group larger than a shard's
    share makes its shard larger than the others, which then stay level.

    Rows are numbered inside (task, shard) as they are written, then the rows of
    the tasks before are added, so slots have no gaps and no task holds a shard.

    Null texts count as empty ones and share their group. Repeated rows have a
    slot each; ties go to the older partial partition. A text of any length is
    one row of its size. A null id stays null. Columns of other names are
    ignored; an empty table gives no rows.
    """
    body = F.coalesce(F.col(text), F.lit(""))
    rows = documents.select(
        F.col(doc_id).alias("doc_id"), (F.octet_length(body).cast("long") + ROW_BYTES).alias("size"), F.crc32(body).alias("text_crc32"),
        F.pmod(F.xxhash64(body), F.lit(units)).cast("int").alias("unit"), *([F.col(text).alias("text")] if keep_text else []))
    rows = checkpoint(rows)
    sums = rows.groupBy("unit").agg(F.sum("size").alias("size")).orderBy("unit").collect()
    shard_of = np.zeros(units, dtype=np.int32)
    shard_of[[r["unit"] for r in sums]] = differencing([r["size"] for r in sums], shards)
    columns = [c for c in rows.columns if c != "unit"]
    schema = ", ".join(f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in columns)
    numbered = checkpoint(rows.mapInArrow(_number(shard_of, shards, columns), f"{schema}, shard int, task int, rank long"))
    before = W.partitionBy("shard").orderBy("task").rowsBetween(W.unboundedPreceding, -1)
    starts = numbered.groupBy("shard", "task").agg(F.count("*").alias("n")).select(
        "shard", "task", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))
    return (numbered.join(broadcast_if_small(starts), ["shard", "task"])
            .select(*columns, "shard", (F.col("start") + F.col("rank")).alias("slot")))


def write_shards(placed: DataFrame, path: str, mode: str = "error") -> None:
    """Rows of ``shard_documents`` as Parquet, a folder ``shard=K`` each, in order of their slots.

    Ranges of (shard, slot) are written by different tasks, so a shard is as many
    files as it needs.
    """
    parts = max(1, int(placed.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    (placed.repartitionByRange(parts, "shard", "slot").sortWithinPartitions("shard", "slot")
     .write.mode(mode).partitionBy("shard").parquet(path))
