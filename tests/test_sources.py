import gzip
import io
import json
import tarfile

import pytest
from pyspark.sql import functions as F

from countygeo.operators import reports as rp
from countygeo.operators import sampling as sm
from countygeo.operators import spatial as spt
from countygeo.sources import readers, sinks, trajectory, webdataset

BLOBS = {"a1": b"x" * 768, "a2": b"y" * 1000, "b1": b"z" * 4104, "b2": b"123"}


def make_shards(folder):
    for shard, keys in (("s0.tar", ["a1", "a2"]), ("s1.tar", ["b1", "b2"])):
        with tarfile.open(folder / shard, "w", format=tarfile.GNU_FORMAT) as tar:
            for key in keys:
                note = b"{broken" if key == "b2" else json.dumps({"adcode": key, "n": 1}).encode()
                for name, blob in ((f"{key}.jpg", BLOBS[key]), (f"{key}.json", note)):
                    info = tarfile.TarInfo(name)
                    info.size = len(blob)
                    tar.addfile(info, io.BytesIO(blob))


def test_shards_and_loose_files_agree(spark, tmp_path):
    shards, loose = tmp_path / "t", tmp_path / "f"
    shards.mkdir()
    make_shards(shards)
    for key, blob in BLOBS.items():
        (loose / key[0]).mkdir(parents=True, exist_ok=True)
        (loose / key[0] / f"{key}.jpg").write_bytes(blob)
    for folder in (shards, loose):
        assert {r.key: bytes(r.content) for r in webdataset.open_index(spark, str(folder)).collect()} == BLOBS
    notes = {r.key: r.meta for r in webdataset.with_sidecars(webdataset.read_shards(spark, f"{shards}/*.tar", meta=True)).collect()}
    assert json.loads(notes["a1"]) == {"adcode": "a1", "n": 1} and notes["b2"] is None
    (tmp_path / "none").mkdir()
    with pytest.raises(ValueError):
        webdataset.open_index(spark, str(tmp_path / "none"))


def test_offsets_point_at_the_bytes(spark, tmp_path):
    make_shards(tmp_path)
    for r in webdataset.read_shards(spark, f"{tmp_path}/*.tar", content=False).collect():
        data = (tmp_path / r.shard).read_bytes()
        assert data[r.data_offset:r.data_offset + r["size"]] == BLOBS[r.key]


def test_truncated_shard_raises(spark, tmp_path):
    make_shards(tmp_path)
    data = (tmp_path / "s1.tar").read_bytes()
    (tmp_path / "s1.tar").write_bytes(data[:2000])
    with pytest.raises(Exception, match="truncated|unexpected end|ends inside"):
        webdataset.read_shards(spark, f"{tmp_path}/*.tar").collect()


def varint(n):
    out = bytearray()
    while n >= 128:
        out.append(n & 127 | 128)
        n >>= 7
    return bytes(out + bytes([n]))


def text(s):
    return varint(len(s)) + s.encode()


def export(version, vehicle, points):
    kinds = 4 if version == 2 else 5
    body = varint(version) + text(vehicle) + text("x") + text("y") + varint(1) + varint(0) * kinds + varint(1)
    body += varint(1) + varint(2) + varint(3) + text("t") + varint(0) * kinds + varint(len(points))
    for day, code in points:
        body += varint(day) + varint(code) + varint(7) + varint(0) * kinds
    if version >= 4:
        body += varint(1) + varint(5) + text("z")
    return b"SVTR" + body


def test_trajectories(spark, tmp_path):
    one = export(2, "090_0000_5m", [(18000, 510105), (18001, 510105), (18400, 0), (18400, 110102)])
    inner = [gzip.compress(export(v, f"v{v}", [(17000 + v, 650101)])) for v in (3, 4)]
    bundle = b"SVTB" + varint(2) + b"".join(varint(len(b)) + b for b in inner)
    (tmp_path / "a.gz").write_bytes(gzip.compress(one))
    (tmp_path / "b.gz").write_bytes(gzip.compress(bundle))
    (tmp_path / "c.gz").write_bytes(gzip.compress(one))
    got = {(r.vehicle, r.year): r.codes for r in trajectory.coverage_table(spark, f"{tmp_path}/*.gz").collect()}
    assert got == {("090_0000_5M", "2019"): ["510104"], ("090_0000_5M", "2020"): ["110101"],
                   ("V3", "2016"): ["650100"], ("V4", "2016"): ["650100"]}


@pytest.mark.parametrize("data", [b"NOPE", b"SVTR" + varint(9), export(4, "v", [(1, 2)])[:-3], b"SVTR" + b"\xff" * 12])
def test_bad_trajectories_raise(data):
    with pytest.raises(ValueError):
        list(trajectory.decode(data))


def test_positions(spark, tmp_path):
    def write(rows):
        (tmp_path / "p.json").write_text(json.dumps({"customCoordinates": [
            {"panoId": k, "lng": x, "lat": y} for k, x, y in rows]}, indent=1))
        return str(tmp_path / "p.json")

    assert readers.read_positions(spark, write([("a", 1, 2), ("a", 1, 2), ("b", 3, 4)])).count() == 2
    for bad in ([("a", 1, 2), ("a", 1, 3)], [("a", 500, 2)]):
        with pytest.raises(ValueError):
            readers.read_positions(spark, write(bad))


def test_samples_and_split(spark, tmp_path):
    path = tmp_path / "samples.jsonl"
    row = {"panoid": "p", "adcode": "510101", "lng": 1.0, "lat": 2.0}
    path.write_text(json.dumps(row) + "\n")
    assert readers.read_samples(spark, str(path)).count() == 1
    path.write_text((json.dumps(row) + "\n") * 2)
    with pytest.raises(ValueError, match="duplicate"):
        readers.read_samples(spark, str(path))
    (tmp_path / "split.json").write_text(json.dumps({"seed": 3, "assignments": {"p": "train", "q": "val_same"}}, indent=2))
    rows, payload = readers.read_split(spark, str(tmp_path / "split.json"))
    assert {r.panoid: r.split for r in rows.collect()} == {"p": "train", "q": "val_same"} and payload.first().seed == 3


def test_names_points_and_boundaries(spark, tmp_path):
    (tmp_path / "n.json").write_text(json.dumps({"510000": "S", "510100": "C"}))
    (tmp_path / "l.json").write_text(json.dumps({"510100": "L", "510101": "D"}))
    names = {r.adcode: r.name for r in readers.read_names(spark, str(tmp_path / "n.json"), str(tmp_path / "l.json")).collect()}
    assert names == {"510000": "S", "510100": "L", "510101": "D"}
    assert readers.read_names(spark, str(tmp_path / "no.json"), optional=True).isEmpty()
    points = spark.createDataFrame([("b", 0, 1.0, 2.0), ("a", 1, 3.0, 4.0), ("a", 0, 5.0, 6.0)], readers.schemas.POINTS)
    sinks.write_points(points, f"{tmp_path}/points")
    back = readers.read_points(spark, f"{tmp_path}/points")
    assert [r.lng for r in readers.points_of(back, "a").collect()] == [5.0, 3.0]
    with pytest.raises(KeyError):
        readers.points_of(back, "zz")
    square = [[[0, 0], [1, 0], [1, 1], [0, 1], [0, 0]]]
    geo = {"features": [
        {"properties": {"adcode": 510101, "level": "district"}, "geometry": {"type": "Polygon", "coordinates": square}},
        {"properties": {"adcode": 510102, "level": "city"}, "geometry": {"type": "Polygon", "coordinates": square}},
        {"properties": {"adcode": 510103, "level": "district"}, "geometry": {"type": "MultiPolygon", "coordinates": [
            [[[x + 2, y] for x, y in square[0]]]]}}]}
    (tmp_path / "510000_full.json").write_text(json.dumps(geo))
    (tmp_path / "100000_full.json").write_text(json.dumps(geo))
    (tmp_path / "520000_full.json").write_text("{not json")
    edges = readers.read_boundaries(spark, str(tmp_path))
    assert edges.count() == 8
    pts = spark.createDataFrame([(1, 0.5, 0.5), (2, 2.5, 0.5), (3, 9.0, 9.0)], "id int, lng double, lat double")
    got = {r.id: r.located for r in spt.locate(pts, spt.polygon_cells(edges)).collect()}
    assert got == {1: "510101", 2: "510103", 3: None}


def test_sinks(spark, tmp_path):
    split = spark.createDataFrame([("p", "train"), ("q", "val_same"), ("r", "train")], "panoid string, split string")
    held = spark.createDataFrame([("510101",)], "adcode string")
    sinks.write_split(split, held, {"per_county": 15}, 7, f"{tmp_path}/split")
    meta = spark.read.json(f"{tmp_path}/split/meta").first()
    assert meta.counts.train == 2 and meta.holdout_adcodes == ["510101"]
    rows = spark.range(10).select(F.col("id").cast("string").alias("panoid"), F.lit(10).alias("bytes"), F.floor(F.col("id") / 4).alias("shard"))
    sinks.write_shards(rows, f"{tmp_path}/sh", missing=split)
    doc = spark.read.json(f"{tmp_path}/sh/manifest").first()
    assert (doc.samples, doc.bytes, doc.missing_count, doc.missing) == (10, 100, 3, ["p", "q", "r"])
    assert spark.read.parquet(f"{tmp_path}/sh/samples").count() == 10
    scan = spark.createDataFrame([("p" * 20, 1.0, 2.0, "510101"), ("q" * 20, 1.1, 2.0, "110101")], "panoid string, lng double, lat double, adcode string")
    pool = sm.sample_pool(scan)
    sinks.write_histogram(sm.coverage_histogram(scan, pool), sm.coverage_totals(scan, pool, sm.point_table(scan)), f"{tmp_path}/hist")
    doc = spark.read.json(f"{tmp_path}/hist").first()
    assert doc.totals.sample_rows == 2 and doc.counties["510101"].available == 1
    probs = spark.createDataFrame([(1, [0.25, 0.75])], "sample_id int, probs array<double>")
    sinks.write_probabilities(probs, F.array(F.lit("a"), F.lit("b")), f"{tmp_path}/probs")
    assert spark.read.json(f"{tmp_path}/probs").first().county_probabilities.asDict() == {"a": 0.25, "b": 0.75}


@pytest.mark.parametrize("document_rows", [1, 7, 30, 1000])
def test_split_reads_alike_from_any_number_of_documents(spark, tmp_path, document_rows):
    split = spark.createDataFrame([(f"p{i}", "train" if i % 3 else "val_same") for i in range(30)], "panoid string, split string")
    for part in (split, split.limit(0)):
        sinks.write_split_documents(part, 7, f"{tmp_path}/split", document_rows)
        rows, payload = readers.read_split(spark, f"{tmp_path}/split")
        assert rows.exceptAll(part).isEmpty() and rows.count() == part.count()
        assert [r.seed for r in payload.collect()] == [7]
    (tmp_path / "split" / "other.json").write_text('{"seed": 8, "assignments": {}}')
    with pytest.raises(ValueError, match="disagree"):
        readers.read_split(spark, f"{tmp_path}/split")


def test_loose_files_written_and_read(spark, tmp_path):
    rows = [("a", b"\x00\xff", '{"x": 1}'), ("b", None, None), (None, b"no", None), ("d", b"d", None), ("c-\u00e9", b"z" * 100_000, "{}")]
    table = spark.createDataFrame(rows, "key string, content binary, meta string").withColumn("sub", F.lit("clash"))
    for _ in range(2):  # a repeated write changes nothing
        wrote = sinks.write_files(table, f"{tmp_path}/loose", folders=2)
        assert sorted(tuple(r) for r in wrote.collect()) == [("a", 2), ("c-\u00e9", 100_000), ("d", 1)]
    back = sorted((r.key, bytes(r.content), r.meta) for r in readers.read_files(spark, f"{tmp_path}/loose").collect())
    assert back == [("a", b"\x00\xff", '{"x": 1}'), ("c-\u00e9", b"z" * 100_000, "{}"), ("d", b"d", None)]
    assert not [p for p in (tmp_path / "loose").rglob("_*") if p.is_file()]
    assert sinks.write_files(table.limit(0), f"{tmp_path}/none").count() == 0


def test_loose_files_are_listed_by_the_tasks(spark, tmp_path, monkeypatch):
    folder = tmp_path / "a b%20c-\u00e9"
    rows = [(f"k{i}", bytes([i]) * (i + 1), None if i % 3 else f'{{"n": {i}}}') for i in range(60)] + [("_x.y", b"x", "{}")]
    sinks.write_files(spark.createDataFrame(rows, "key string, content binary, meta string"), str(folder), folders=40)
    (folder / "00000" / "deep").mkdir(parents=True)
    (folder / "00000" / "deep" / "no.jpg").write_bytes(b"no")
    (folder / "00000" / "no.JPG").write_bytes(b"no")
    (folder / "no.jpg").write_bytes(b"no")
    index = readers._files_by_index(spark, str(folder))
    read = readers.read_files(spark, str(folder))
    # Spark's list leaves out names that begin with _ and takes images outside the sub-folders.
    assert sorted(r for r in read.collect() if r.key != "_x.y") == sorted(r for r in index.collect() if r.key != "no")
    assert sorted((r.key, bytes(r.content), r.meta) for r in read.collect()) == sorted(rows)
    assert read.dtypes == index.dtypes
    # The driver holds no list of files, and reads none that are not asked for.
    assert not read.inputFiles() and "BatchEvalPython" not in read.select("key", "size")._jdf.queryExecution().executedPlan().toString()
    monkeypatch.setattr(readers, "arrow_uri", lambda *_: ("", "s3a://x/y"))
    assert readers.read_files(spark, str(folder)).count() == index.count()


def test_documents_sidecars_and_identity(spark, tmp_path):
    split = spark.createDataFrame([(f"p{i}", "train" if i % 3 else "val_same") for i in range(30)], "panoid string, split string")
    sinks.write_split_documents(split, 7, f"{tmp_path}/split")
    rows, payload = readers.read_split(spark, f"{tmp_path}/split")
    assert rows.exceptAll(split).isEmpty() and rows.count() == 30 and payload.first().seed == 7
    samples = split.select("panoid", F.lit("510101").alias("adcode"))
    test = split.withColumn("split", F.lit("test_county"))
    sinks.write_split(test, samples.select("adcode").limit(0), {"budget": 1}, 1, f"{tmp_path}/meta", samples)
    assert spark.read.json(f"{tmp_path}/meta/meta").first().test_counties_present == ["510101"]

    (tmp_path / "loose" / "a").mkdir(parents=True)
    for name in ("x.jpg", "y.jpeg"):
        (tmp_path / "loose" / "a" / name).write_bytes(b"image")
    (tmp_path / "loose" / "a" / "x.json").write_text('{"adcode": "510101"}')
    found = {r.key: r.meta for r in readers.read_files(spark, f"{tmp_path}/loose").collect()}
    assert found == {"x": '{"adcode": "510101"}', "y": None}

    files = spark.createDataFrame([("m", b"1"), ("c", b"2")], "path string, content binary")
    ids = spark.range(100).withColumnRenamed("id", "sample_id")
    one = rp.cache_identity(files, ids)
    assert rp.same_identity(one, rp.cache_identity(files.orderBy("path"), ids.repartition(7)))
    assert not rp.same_identity(one, rp.cache_identity(files, ids.union(ids.limit(1))))
    assert not rp.same_identity(one, rp.cache_identity(files.limit(1), ids))
    assert not rp.same_identity(one.drop("version"), one)
    placed = ids.withColumn("place", F.col("sample_id") * 2)
    ordered = rp.cache_identity(files, placed, order="place")
    swapped = placed.withColumn("place", F.when(F.col("sample_id") == 3, 8).when(F.col("sample_id") == 4, 6).otherwise(F.col("place")))

    def changes(current):
        return [(r.same, r.changed) for r in rp.identity_changes(ordered, current).collect()]

    flipped = files.withColumn("content", F.when(F.col("path") == "c", F.lit(b"3")).otherwise(F.col("content")))
    assert changes(rp.cache_identity(files, placed.repartition(5), order="place")) == [(True, [])]
    assert changes(rp.cache_identity(files, swapped, order="place")) == [(False, ["ids_sha256"])]
    assert changes(rp.cache_identity(flipped, placed, order="place")) == [(False, ["files_sha256"])]
    assert changes(rp.cache_identity(files, placed, order="place", preprocess="crop")) == [(False, ["preprocess"])]
    assert changes(ordered.drop("version")) == [(False, ["version"])]
    assert rp.identity_changes(ordered.limit(0), ordered).count() == 0
    empty = rp.cache_identity(files.limit(0), ids.limit(0)).first()
    assert (empty.n_files, empty.n_ids) == (0, 0)
