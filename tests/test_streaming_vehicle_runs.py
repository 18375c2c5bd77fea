import datetime

import pytest
from pyspark.sql import functions as F

from countygeo.operators import ingest as ig
from countygeo.operators import runlog as rl
from countygeo.operators import vehicles as vh
from countygeo.operators.sampling import reservoir
from countygeo.plans import registry, stream
from countygeo.streaming import ingest as st

SCHEMA = "event_id bigint, key bigint, updated timestamp, state string, bytes bigint"
T0 = datetime.datetime(2024, 1, 1)


def write(spark, path, rows):
    frame = spark.createDataFrame([(i, k, T0 + datetime.timedelta(seconds=s), state, 1) for i, k, s, state in rows], SCHEMA)
    frame.coalesce(1).write.mode("append").parquet(path)
    return frame


def source(spark, path):
    return spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(path)


def test_stream_results_keep_no_state_of_all_ids(spark, monkeypatch):
    run, queries = st.run_available, []
    monkeypatch.setattr(st, "run_available", lambda *how: queries.append(run(*how)) or queries[-1])
    rows = stream.stream_results(spark, "/root/testdata/sf0.001")
    assert len(queries) == stream.STEPS and not any(p["stateOperators"] for q in queries for p in q.recentProgress)
    ids = rows.select("panoid")
    assert ids.count() == ids.distinct().count() == 1500


def test_newest_row_of_each_key_over_batches(spark, tmp_path):
    schema = "id string, line bigint, ok boolean"
    batches = [[("a", 1, True), ("a", 4, None), ("b", 2, True)], [("a", 3, False), ("c", 9, True), ("b", 5, False)], [("c", 8, False)]]
    sink = st.latest_sink(f"{tmp_path}/out", "id", ["line"])
    for n in (0, 1, 1, 2):  # batch 1 is replayed
        sink(spark.createDataFrame(batches[n], schema), n)
    got = st.read_latest(spark, f"{tmp_path}/out", spark.createDataFrame([], schema).schema, "id", ["line"])
    assert sorted(tuple(r) for r in got.collect()) == [("a", 4, None), ("b", 5, False), ("c", 9, True)]


def test_restart_continues_and_equals_batch(spark, tmp_path):
    src, out, chk = (f"{tmp_path}/{d}" for d in ("src", "out", "chk"))
    first = write(spark, src, [(1, 1, 0, "pending_meta"), (2, 2, 1, "pending_meta"), (3, 1, 5, "done")])
    st.run_available(st.latest_state(source(spark, src)), st.table_sink(out), "update", chk)
    second = write(spark, src, [(4, 1, 2, "meta_ok"), (5, 2, 9, "fail"), (6, 3, 9, "done")])
    query = st.run_available(st.latest_state(source(spark, src)), st.table_sink(out), "update", chk)
    assert sum(p["numInputRows"] for p in query.recentProgress) == 3
    rows = st.newest_rows(st.read_sink(spark, out, st.latest_state(source(spark, src)).schema), ["key"])
    got = {r.key: r.state for r in rows.collect()}
    assert got == {r.key: r.state for r in ig.fold_state(first.unionByName(second)).collect()} == {1: "done", 2: "fail", 3: "done"}


def test_late_rows_are_dropped_in_append_mode(spark, tmp_path):
    src, out, chk = (f"{tmp_path}/{d}" for d in ("src", "out", "chk"))
    batches = [[(1, 1, 1, "done"), (2, 1, 16, "done")], [(3, 1, 7200, "done")], [(4, 1, 2, "done")], [(5, 1, 20000, "done")]]
    for rows in batches:
        write(spark, src, rows)
        result = st.progress(source(spark, src))
        st.run_available(result, st.table_sink(out), "append", chk)
    rows = st.read_sink(spark, out, result.schema).orderBy("start").collect()
    assert [(r.n, r.ok) for r in rows[:2]] == [(1, 1), (1, 1)] and sum(r.n for r in rows) == 3


def test_progress_closes_windows_over_many_batches(spark, tmp_path):
    src, out, chk = (f"{tmp_path}/{d}" for d in ("src", "out", "chk"))
    for k in range(5):
        write(spark, src, [(3 * k + j, j, 3600 * k + 40 * j, "done") for j in range(3)])
        result = st.progress(source(spark, src), "30 minutes")
        st.run_available(result, st.table_sink(out), "append", chk)
    rows = st.read_sink(spark, out, result.schema)
    assert st.committed(spark, chk) >= 4 and rows.select("batch").distinct().count() > 3
    assert sum(r.n for r in rows.collect()) == 12 and rows.count() == rows.select("start").distinct().count()


def test_first_insert_keeps_the_earliest_row_and_forgets(spark, tmp_path):
    src, out, chk = (f"{tmp_path}/{d}" for d in ("src", "out", "chk"))
    hour = 3600
    for rows in ([(5, 1, 600, "late first"), (1, 2, 700, "b")], [(2, 1, 300, "a"), (3, 1, 900, "no")], [(4, 1, 10 * hour, "again")],
                 [(9, 3, 40 * hour, "end")], [(10, 3, 80 * hour, "end")]):
        write(spark, src, rows)
        result = st.first_insert(source(spark, src), delay="1 hour", keep="2 hours")
        st.run_available(result, st.table_sink(out), "append", chk)
    got = sorted((r.key, r.state) for r in st.read_sink(spark, out, result.schema).collect())
    assert got == [(1, "a"), (1, "again"), (2, "b"), (3, "end")]


def test_a_row_out_of_order_joins_two_sessions(spark, tmp_path):
    src, out, chk = (f"{tmp_path}/{d}" for d in ("src", "out", "chk"))
    minute = 60
    for rows in ([(1, 1, 0, "a"), (2, 1, 50 * minute, "a")], [(3, 1, 25 * minute, "a")], [(4, 2, 600 * minute, "a")], [(5, 2, 900 * minute, "a")]):
        write(spark, src, rows)
        result = st.sessions(source(spark, src), gap="30 minutes", delay="2 hours")
        st.run_available(result, st.table_sink(out), "append", chk)
    assert sorted((r.key, r.n) for r in st.read_sink(spark, out, result.schema).collect()) == [(1, 3), (2, 1)]


def test_reservoir_continues_after_a_restart(spark, tmp_path):
    src, state = f"{tmp_path}/src", f"{tmp_path}/state"
    schema = "panoid string, adcode string"
    rows = [(f"p{k:04d}", f"{51 + k % 2}0101") for k in range(400)]
    quotas = {"per_county": 3, "focus": 5, "factor": 2}
    (tmp_path / "src").mkdir()
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(src)
    empty = st.streamed_reservoir(stream, state, **quotas)
    assert empty.count() == 0 and empty.columns == ["panoid", "adcode"] and st.committed(spark, f"{state}/checkpoint") is None
    for part in range(4):
        spark.createDataFrame(rows[100 * part:100 * part + 100], schema).coalesce(1).write.mode("append").parquet(src)
        if part != 2:  # the third and fourth file come in one run
            got = st.streamed_reservoir(stream, state, **quotas)
    again = st.streamed_reservoir(stream, state, **quotas)
    expected = sorted(map(tuple, reservoir(spark.createDataFrame(rows, schema), **quotas).collect()))
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, again.collect())) == expected and len(expected) == 16
    assert st.committed(spark, f"{state}/checkpoint") == 3
    assert sorted(p.name for p in (tmp_path / "state").glob("v=*")) == ["v=2", "v=3"]


def test_a_replayed_batch_repeats_its_step(spark, tmp_path):
    schema = "panoid string, adcode string"
    first, second = (spark.createDataFrame([(f"p{k}", "510101") for k in part], schema) for part in (range(50), range(50, 90)))
    merge = st.reservoir_sink(str(tmp_path), per_county=3, focus=5, factor=2)
    merge(first, 0)
    merge(second, 1)
    once = sorted(spark.read.parquet(f"{tmp_path}/v=1").collect())
    merge(second, 1)
    assert sorted(spark.read.parquet(f"{tmp_path}/v=1").collect()) == once


def test_coverage_prior_rules(spark):
    coverage = spark.createDataFrame([("V1", "2019", "a"), ("V1", "2019", "b"), ("V1", "2020", "z"), ("V2", "2019", "zz")],
                                     "vehicle string, year string, adcode string")
    allowed = spark.createDataFrame([("a",), ("b",), ("c",)], "adcode string")
    rows = [(1, {"v1": 0.6, "V2": 0.3, "V9": 0.1}, {"2019": 0.5, "2020": 0.5}), (2, {"v1": 1.0}, {}), (3, {"V9": 1.0}, {"2019": 1.0})]
    preds = spark.createDataFrame(rows, "sample_id int, vehicle_probs map<string,double>, year_probs map<string,double>")
    got = {r.sample_id: r for r in vh.coverage_prior(preds, coverage, allowed).collect()}
    assert got[1].supported_mass == pytest.approx(0.6) and got[1].prior == pytest.approx({"a": 0.5, "b": 0.5})
    assert got[2].supported_mass == pytest.approx(1.0) and got[3].supported_mass == 0 and got[3].prior == {}
    wide = coverage.union(spark.createDataFrame([("V2", "2019", "b"), ("V9", "2018", "c")], coverage.schema))
    one, many = (sorted((r.sample_id, round(r.supported_mass, 9), sorted((k, round(v, 9)) for k, v in r.prior.items()))
                        for r in vh.coverage_prior(preds, wide, allowed, block_codes=n).collect()) for n in (10_000, 1))
    small = sorted((r.sample_id, round(r.supported_mass, 9), sorted((k, round(v, 9)) for k, v in r.prior.items()))
                   for r in vh.coverage_prior(preds, wide, allowed, cells=1).collect())
    assert one == many == small and one[0][1] == 1.0 and one[2][2] == [("c", 1.0)]
    assert all(r.prior == {} and r.supported_mass == 0 for r in vh.coverage_prior(preds, coverage.limit(0), allowed).collect())


def test_blend_is_bounded(spark):
    rows = [(1, [0.8, 0.2], {"b": 1.0}, 0.9, 0.9), (2, [0.8, 0.2], {"b": 1.0}, 0.5, 0.9), (3, [0.8, 0.2], {}, 0.9, 0.9),
            (4, [0.8, 0.2], {"b": 1.0}, 0.6, 0.5)]
    df = spark.createDataFrame(rows, "sample_id int, env array<double>, prior map<string,double>, confidence double, supported_mass double")
    df = vh.align_prior(df, ["a", "b"])
    got = {r.sample_id: r for r in vh.blend_prior(df).collect()}
    assert [got[i].applied for i in (1, 2, 3, 4)] == [True, False, False, True]
    q = [0.05, 0.95]
    adjusted = [0.8 * q[0], 0.2 * q[1]]
    want = [0.75 * e + 0.25 * a / sum(adjusted) for e, a in zip([0.8, 0.2], adjusted)]
    assert got[1].blended == pytest.approx(want) and got[2].blended == pytest.approx([0.8, 0.2])
    with pytest.raises(ValueError):
        vh.blend_prior(df, strength=0.5)


def test_best_epoch_is_strict(spark):
    df = spark.createDataFrame([(0, 0.1), (1, 0.3), (2, 0.3), (3, 0.4), (4, None)], "epoch int, m double")
    assert [r.is_best for r in rl.best_epochs(df, "m").orderBy("epoch").collect()] == [True, True, False, True, False]


def test_round_robin_subset(spark):
    df = spark.createDataFrame([(f"a{i}", "a") for i in range(50)] + [("b0", "b"), ("c0", "c"), ("c1", "c")], "k string, s string")
    picked = rl.stratified_subset(df, "k", "s", 6).collect()
    counts = {s: sum(r.s == s for r in picked) for s in "abc"}
    assert counts == {"a": 3, "b": 1, "c": 2}


def test_registry_names_match():
    queries, oracles = registry.load()
    assert len(queries) > 110 and set(oracles) <= set(queries)
