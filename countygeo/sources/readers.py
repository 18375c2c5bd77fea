"""Readers for the stored layouts."""

from __future__ import annotations

import functools
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from countygeo.functions import geo
from countygeo.functions.scalar import fingerprint
from countygeo.operators.checks import duplicates, require_empty
from countygeo.operators.reports import merge_names
from countygeo.runtime import arrow_uri
from countygeo.sources import schemas

# Names of files that a task sends on at once.
NAMES = 10_000


def read_panos(spark: SparkSession, path: str, fmt: str = "parquet", **options: str) -> DataFrame:
    """Master table from files or, with fmt='jdbc', from a database (SRC1)."""
    if fmt == "jdbc":
        return spark.read.format("jdbc").options(**options).load()
    return spark.read.format(fmt).options(**options).schema(schemas.PANOS).load(path)


def read_samples(spark: SparkSession, path: str, check: bool = True) -> DataFrame:
    """samples.jsonl keyed by id (SRC4).

    A repeated id raises: parallel reads have no last line to prefer.
    """
    df = spark.read.schema(schemas.SAMPLES).option("mode", "FAILFAST").json(path)
    if check:
        require_empty(duplicates(df, "panoid"), "duplicate ids in samples")
    return df


def read_split(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Assignments as rows, and the one-row payload around them (SRC5).

    A path may hold one document or many with the same payload; documents that
    disagree raise.
    """
    documents = spark.read.schema(schemas.SPLIT_FILE).option("mode", "FAILFAST").json(path, multiLine=True)
    rows = documents.select(F.explode("assignments").alias("panoid", "split"))
    around = documents.drop("assignments")
    payload = around.withColumn("__text", F.to_json(F.struct("*"))).groupBy("__text").agg(
        *[F.first(c).alias(c) for c in around.columns]).drop("__text")
    require_empty(payload.agg(F.count("*").alias("n")).where("n > 1"), "documents of one split disagree")
    return rows, payload


def read_positions(spark: SparkSession, path: str) -> DataFrame:
    """True positions; invalid or conflicting coordinates raise (SRC6, FIL6)."""
    raw = spark.read.schema(schemas.POSITIONS_FILE).option("mode", "FAILFAST").json(path, multiLine=True)
    rows = raw.select(F.inline("customCoordinates")).withColumnRenamed("panoId", "sample_id")
    require_empty(rows.where(~geo.valid_lnglat("lng", "lat")), "a given position is no valid place")
    distinct = rows.groupBy("sample_id", "lng", "lat").agg(F.max("heading").alias("heading"))
    require_empty(duplicates(distinct, "sample_id"), "one id has several positions")
    return distinct


def read_points(spark: SparkSession, path: str) -> DataFrame:
    """County point table (SRC7)."""
    return spark.read.schema(schemas.POINTS).parquet(path)


def points_of(points: DataFrame, adcode: str) -> DataFrame:
    """Points of one county; an absent county raises KeyError (SRC7)."""
    rows = points.where(F.col("adcode") == adcode).orderBy("seq")
    if rows.isEmpty():
        raise KeyError(f"no points for {adcode}")
    return rows


def read_names(spark: SparkSession, base: str, legacy: str | None = None, optional: bool = False) -> DataFrame:
    """Division names as rows, legacy entries override (SRC12).

    With ``optional`` a missing file means no names; a malformed one always raises.
    """
    def one(path: str) -> DataFrame:
        text = spark.read.text(path, wholetext=True)
        return text.select(F.explode(F.from_json("value", "map<string,string>", {"mode": "FAILFAST"})).alias("adcode", "name"))

    try:
        names = one(base)
        return merge_names(names, one(legacy)) if legacy else names
    except AnalysisException as e:
        if optional and e.getCondition() == "PATH_NOT_FOUND":
            return spark.createDataFrame([], "adcode string, name string")
        raise


def read_boundaries(spark: SparkSession, folder: str) -> DataFrame:
    """District boundaries as an edge table in file and feature order (SRC13).

    Unreadable files and features are skipped, the country file is left out.
    """
    files = spark.read.text(f"{folder}/*_full.json", wholetext=True).select(
        F.input_file_name().alias("file"), "value").where(~F.col("file").endswith("100000_full.json"))
    features = files.select("file", F.from_json("value", schemas.BOUNDARY_FILE).alias("d")).select(
        "file", F.posexplode("d.features").alias("pos", "f")).where(F.col("f.properties.level") == "district")
    kind = F.col("f.geometry.type")
    text = F.col("f.geometry.coordinates")
    rings = "array<array<array<double>>>"
    parts = F.when(kind == "MultiPolygon", F.from_json(text, f"array<{rings}>")).when(
        kind == "Polygon", F.array(F.from_json(text, rings)))
    # Features are ordered by file name and place, packed into one sortable value.
    ordered = features.select(
        F.struct("file", "pos").alias("ord"), F.col("f.properties.adcode").alias("adcode"), F.explode(parts).alias("poly"))
    ring = ordered.select("ord", "adcode", F.explode("poly").alias("ring")).where(F.size("ring") >= 2)
    edges = F.transform(F.sequence(F.lit(0), F.size("ring") - 2), lambda i: F.struct(
        F.get(F.get("ring", i), F.lit(0)).alias("x1"), F.get(F.get("ring", i), F.lit(1)).alias("y1"),
        F.get(F.get("ring", i + 1), F.lit(0)).alias("x2"), F.get(F.get("ring", i + 1), F.lit(1)).alias("y2")))
    return ring.select("ord", "adcode", F.inline(edges)).where(
        F.col("x1").isNotNull() & F.col("y1").isNotNull() & F.col("x2").isNotNull() & F.col("y2").isNotNull())


def read_coverage(spark: SparkSession, path: str, multi_line: bool = True) -> DataFrame:
    """Coverage file as (vehicle, year, adcode) rows (SRC15)."""
    raw = spark.read.schema(schemas.COVERAGE_FILE).option("mode", "FAILFAST").json(path, multiLine=multi_line)
    years = raw.select(F.explode("coverage").alias("vehicle", "years")).select(
        "vehicle", F.explode("years").alias("year", "codes"))
    return years.select(F.upper("vehicle").alias("vehicle"), "year", F.explode("codes").alias("adcode"))


def read_run_log(spark: SparkSession, path: str) -> DataFrame:
    """Run log with nested metrics (SRC16)."""
    return spark.read.schema(schemas.RUN_LOG).option("mode", "FAILFAST").json(path)


@functools.lru_cache(maxsize=16)
def _opened(uri: str) -> tuple[fs.FileSystem, str]:
    """The file system of a folder, opened once a worker, and the folder's path in it."""
    return fs.FileSystem.from_uri(uri)


def _list_files(uri: str) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Names and sizes of the images in each sub-folder."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, root = _opened(uri)
        for sub in (sub for batch in batches for sub in batch.column("sub").to_pylist()):
            found = [(i.base_name, i.size) for i in system.get_file_info(fs.FileSelector(f"{root}/{sub}"))
                     if i.type == fs.FileType.File and i.extension in ("jpg", "jpeg")]
            for n in range(0, len(found), NAMES):
                names, sizes = zip(*found[n:n + NAMES])
                yield pa.RecordBatch.from_arrays([pa.array([sub] * len(names)), pa.array(names), pa.array(sizes, pa.int64())],
                                                 ["sub", "name", "size"])

    return run


def _content(uri: str, optional: bool = False) -> Callable[[str], bytes | None]:
    """Bytes of a file below ``uri``; with ``optional`` null if there is none."""
    def read(path: str) -> bytes | None:
        system, root = _opened(uri)
        try:
            with system.open_input_stream(f"{root}/{path}", compression=None) as file:
                return file.read()
        except FileNotFoundError:
            if optional:
                return None
            raise

    return read


def read_files(spark: SparkSession, folder: str) -> DataFrame:
    """Loose images below sub-folders, keyed by file stem, with the JSON beside each, if any (SRC9).

    The driver knows the sub-folders only. Tasks list one each, deal the names over
    the cores and open an image and its sidecar where the name is, so no list of
    files passes the driver. File systems that Arrow does not know are listed by Spark.
    """
    where, uri = arrow_uri(spark, folder)
    try:
        system, root = fs.FileSystem.from_uri(uri)
    except pa.ArrowInvalid:
        return _files_by_index(spark, folder)
    subs = [(i.base_name,) for i in system.get_file_info(fs.FileSelector(root)) if i.type == fs.FileType.Directory]
    names = spark.createDataFrame(subs, "sub string").mapInArrow(_list_files(uri), "sub string, name string, size bigint")
    dealt = names.repartition(4 * spark.sparkContext.defaultParallelism, "sub", "name")
    path = F.concat_ws("/", "sub", "name")
    image = F.udf(_content(uri), "binary", useArrow=False)
    sidecar = F.udf(_content(uri, optional=True), "binary", useArrow=False)
    return dealt.select(
        F.regexp_extract("name", r"^(.+)\.jpe?g$", 1).alias("key"), F.concat(F.lit(f"{where}/"), path).alias("shard"),
        F.lit(0).cast("bigint").alias("data_offset"), "size",
        sidecar(F.regexp_replace(path, r"\.jpe?g$", ".json")).cast("string").alias("meta"), image(path).alias("content"))


def _files_by_index(spark: SparkSession, folder: str) -> DataFrame:
    """``read_files`` by Spark's own list of files, which passes the driver."""
    stem = F.regexp_extract("path", r"^(.*)\.[^./]+$", 1).alias("__stem")

    def files(glob: str) -> DataFrame:
        return spark.read.format("binaryFile").option("pathGlobFilter", glob).load(f"{folder}/*/").withColumn("__stem", stem)

    meta = files("*.json").select("__stem", F.col("content").cast("string").alias("meta"))
    return files("*.{jpg,jpeg}").join(meta, "__stem", "left").select(
        F.regexp_extract("path", r"([^/]+)\.jpe?g$", 1).alias("key"), F.col("path").alias("shard"),
        F.lit(0).cast("bigint").alias("data_offset"), F.col("length").alias("size"), "meta", "content")


def file_fingerprints(spark: SparkSession, glob: str) -> DataFrame:
    """SHA-256 of every matching file (SC31)."""
    return spark.read.format("binaryFile").load(glob).select("path", "length", fingerprint("content").alias("sha256"))
