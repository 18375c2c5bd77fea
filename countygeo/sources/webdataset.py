"""Tar shards as a Spark data source, one partition per file (SRC8, SRC11)."""

from __future__ import annotations

import glob
import json
import os
import tarfile
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from countygeo.sources import schemas
from countygeo.sources.readers import read_files


class TarPartition(InputPartition):
    def __init__(self, path: str):
        super().__init__(path)
        self.path = path


class TarReader(DataSourceReader):
    """Streams the images of a shard; nothing but one member is held in memory."""

    def __init__(self, options: dict[str, str]):
        self.paths = sorted(glob.glob(options.get("path", "")))
        self.with_content = options.get("content", "true") == "true"
        self.with_meta = options.get("meta", "false") == "true"
        if not self.paths:
            raise ValueError("no shards found")

    def partitions(self) -> list[TarPartition]:
        return [TarPartition(p) for p in self.paths]

    def read(self, partition: TarPartition) -> Iterator[tuple]:
        shard = os.path.basename(partition.path)
        end = os.path.getsize(partition.path)
        with tarfile.open(partition.path, "r") as tar:
            for member in tar:
                stem, dot, kind = member.name.rpartition(".")
                if not member.isfile() or not dot:
                    continue
                if kind in ("jpg", "jpeg"):
                    blob = None
                    if member.offset_data + member.size > end:
                        raise OSError(f"{stem}: shard {shard} is truncated")
                    if self.with_content:
                        blob = tar.extractfile(member).read()
                        if len(blob) != member.size:
                            raise OSError(f"{stem}: wanted {member.size} bytes, got {len(blob)}")
                    yield stem, shard, member.offset_data, member.size, None, blob
                elif kind == "json" and self.with_meta:
                    text = tar.extractfile(member).read()
                    try:
                        json.loads(text)
                    except ValueError:
                        continue
                    yield stem, shard, None, None, text.decode("utf-8"), None


class WebDataset(DataSource):
    """``spark.read.format("webdataset")`` over a glob of tar files."""

    @classmethod
    def name(cls) -> str:
        return "webdataset"

    def schema(self) -> str:
        return schemas.MEMBERS

    def reader(self, schema) -> TarReader:
        return TarReader(self.options)


def read_shards(spark: SparkSession, path: str, content: bool = True, meta: bool = False) -> DataFrame:
    """Members of the shards matching ``path``.

    With ``meta`` the JSON sidecars come as rows of their own; ``with_sidecars``
    puts them next to their images.
    """
    spark.dataSource.register(WebDataset)
    return spark.read.format("webdataset").option("content", str(content).lower()).option(
        "meta", str(meta).lower()).load(path)


def with_sidecars(members: DataFrame) -> DataFrame:
    """One row per image with its sidecar; writers put both in the same shard."""
    images = members.where("size IS NOT NULL").drop("meta")
    notes = members.where("meta IS NOT NULL").select("shard", "key", "meta")
    return images.join(notes, ["shard", "key"], "left")


def open_index(spark: SparkSession, folder: str) -> DataFrame:
    """Tar shards if there are any, else loose files, else an error (SRC10)."""
    if glob.glob(f"{folder}/*.tar"):
        return read_shards(spark, f"{folder}/*.tar").drop("meta")
    if any(e.is_dir() for e in os.scandir(folder)):
        return read_files(spark, folder)
    raise ValueError(f"{folder} has neither shards nor sub-folders")
