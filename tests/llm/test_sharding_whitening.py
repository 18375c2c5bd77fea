import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from countygeo.llm import queries as llm_queries
from countygeo.llm import sharding, whitening


def _plain_differencing(sizes, shards):
    """Sums of the parts, with lists in place of permutations."""
    parts = [[s] + [0] * (shards - 1) for s in sizes]
    while len(parts) > 1:
        parts.sort(key=lambda p: p[-1] - p[0])
        a, b = parts[:2]
        parts = parts[2:] + [sorted((x + y for x, y in zip(a, reversed(b), strict=True)), reverse=True)]
    return parts[0]


@pytest.mark.parametrize("shards", [1, 2, 5])
def test_differencing_follows_the_plain_method(shards):
    rng = np.random.default_rng(shards)
    for n in (1, 2, 7, 40):
        sizes = rng.integers(1, 1000, n).tolist()
        shard = sharding.differencing(sizes, shards)
        sums = np.bincount(shard, weights=sizes, minlength=shards)
        assert sorted(sums, reverse=True) == _plain_differencing(sizes, shards)
    assert len(sharding.differencing([], shards)) == 0


def test_differencing_beats_greedy_on_few_large_sizes():
    sizes = [int(x) for x in np.random.default_rng(1).integers(10**6, 10**7, 400)]
    sums = np.bincount(sharding.differencing(sizes, 8), weights=sizes)
    greedy = np.zeros(8)
    for s in sorted(sizes, reverse=True):
        greedy[np.argmin(greedy)] += s
    assert np.ptp(sums) < np.ptp(greedy)


def _check_shards(rows, texts, shards):
    expected = Counter((i, len((t or "").encode()) + 8, zlib.crc32((t or "").encode())) for i, t in texts)
    assert Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in rows) == expected
    slots = defaultdict(list)
    for r in rows:
        slots[r["shard"]].append(r["slot"])
    assert all(sorted(s) == list(range(len(s))) for s in slots.values()) and set(slots) <= set(range(shards))


def test_groups_stay_whole_and_slots_have_no_gaps(spark, odd_docs, no_docs):
    rows = sharding.shard_documents(odd_docs, shards=3, keep_text=True).collect()
    _check_shards(rows, [(r["doc_id"], r["text"]) for r in odd_docs.collect()], 3)
    shard_of = defaultdict(set)
    for r in rows:
        shard_of[r["text"] or ""].add(r["shard"])
    assert all(len(x) == 1 for x in shard_of.values())
    assert sharding.shard_documents(no_docs).count() == 0


@pytest.mark.parametrize("units", [7, 65_536])
def test_a_hot_group_leaves_the_other_shards_level(spark, units):
    docs = spark.range(3000).select(
        F.col("id").alias("doc_id"), F.when(F.col("id") % 3 == 0, "hot text").otherwise(F.expr("repeat('x', int(1 + id % 97)) || id")).alias("text"))
    rows = sharding.shard_documents(docs, shards=6, units=units).collect()
    _check_shards(rows, [(r["doc_id"], r["text"]) for r in docs.collect()], 6)
    hot = {r["shard"] for r in rows if r["doc_id"] % 3 == 0}
    assert len(hot) == 1
    if units > 3000:
        sums = Counter()
        for r in rows:
            sums[r["shard"]] += r["size"]
        assert max(sums.values()) - min(sums.values()) <= 100


def test_written_shards_hold_their_rows_in_order(spark, tmp_path):
    docs = spark.range(200).select(F.col("id").alias("doc_id"), F.expr("'text ' || id % 150").alias("text"))
    placed = sharding.shard_documents(docs, shards=4, keep_text=True)
    sharding.write_shards(placed, str(tmp_path / "out"))
    back = spark.read.parquet(str(tmp_path / "out"))
    assert sorted((r["shard"], r["slot"], r["text"]) for r in back.collect()) == sorted((r["shard"], r["slot"], r["text"]) for r in placed.collect())


def test_sharding_query_is_balanced(spark):
    rows = llm_queries.op11_sharding(spark, "/root/testdata/sf0.01").collect()
    texts = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text").collect()
    _check_shards(rows, [(r["doc_id"], r["text"]) for r in texts], 24)
    sums = Counter()
    for r in rows:
        sums[r["shard"]] += r["size"]
    largest = max(Counter((r["text_crc32"], r["size"]) for r in rows).items(), key=lambda x: x[1] * x[0][1])
    assert max(sums.values()) - min(sums.values()) <= max(0.01 * sum(sums.values()) / 24, largest[1] * largest[0][1])
    assert {r["law"] for r in rows} == {"bytes"} and {r["grown_shard"] for r in rows} == {None}


@pytest.mark.parametrize("rank", [0, 1, 3, 8])
def test_factor_and_rotations(rank):
    rng = np.random.default_rng(rank)
    base = rng.normal(size=(8, rank)) * 10.0 ** -np.arange(rank)
    a = base @ base.T
    factor = whitening.pivoted_cholesky(a)
    assert factor.shape == (8, rank) and np.allclose(factor @ factor.T, a, atol=1e-12)
    values, vectors = whitening.eigen(a)
    expected = np.linalg.eigvalsh(a)[::-1][:rank]
    assert np.allclose(values, expected, rtol=1e-6, atol=0) or rank == 8 and np.allclose(values[:6], expected[:6], rtol=1e-5)
    assert np.allclose(vectors.T @ vectors, np.eye(rank), atol=1e-12)
    assert np.allclose(a @ vectors, vectors * values, atol=1e-12)


def test_pivots_make_a_triangle():
    x = np.random.default_rng(3).normal(size=(30, 6))
    factor = whitening.pivoted_cholesky(x.T @ x)
    order = np.argsort([np.flatnonzero(row).max() for row in factor], kind="stable")
    assert np.allclose(np.triu(factor[order], 1), 0)


def _brute_whitening(vectors, k):
    good = [(i, v) for i, v in vectors if v is not None and len(v) and all(c is not None and np.isfinite(c) for c in v)]
    x = np.array([[int(np.floor(64 * float(c))) + 1_000_000 for c in v] for _, v in good], dtype=object)
    n = len(x)
    exact = n * x - x.sum(axis=0)
    z = exact.astype(float) / n
    cov = z.T @ z / n
    e, u = np.linalg.eigh(cov)
    e, u = e[::-1], u[:, ::-1]
    keep = min(k, int((e > 1e-9 * e.max()).sum())) if e.max() > 0 else 0
    return [i for i, _ in good], n, [int(d) for d in (exact * exact).sum(axis=1)], z @ u[:, :keep] / np.sqrt(e[:keep]), e[:keep] / np.trace(cov)


@pytest.mark.parametrize("scale", [1.0, 1e9])
def test_whitening_against_brute_force(spark, scale):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(300, 5)) @ rng.normal(size=(5, 5)) * scale
    x[:, 4] = x[:, 3]
    rows = [(k, [float(np.float32(c)) for c in v]) for k, v in enumerate(x)]
    rows += [(5, rows[5][1]), (None, rows[6][1]), (900, None), (901, [1.0, None, 0.0, 0.0, 0.0]), (902, [float("nan")] * 5),
             (903, [float("inf"), 0.0, 0.0, 0.0, 0.0]), (904, []), (905, [1.0, 2.0]), (906, [0.0] * 5)]
    df = spark.createDataFrame([(i, v, "clash", 1) for i, v in rows], "vec_id long, embedding array<float>, whitened string, n int")
    model = whitening.fit_whitening(df)
    got = whitening.whiten(df, model).collect()
    ids, n, deviation, white, explained = _brute_whitening([r for r in rows if r[0] != 905], 32)
    assert model.n == n and model.identity_error < 1e-9
    assert Counter((r["vec_id"], r["deviation"]) for r in got) == Counter((i, d if d < 2**63 else None) for i, d in zip(ids, deviation, strict=True))
    by_id = {r["vec_id"]: np.array(r["whitened"]) for r in got}
    mine = np.array([by_id[i] for i in ids])
    sign = np.sign((mine * white).sum(axis=0))
    assert mine.shape == white.shape and np.allclose(mine * sign, white, atol=1e-5)
    assert np.allclose(model.values / model.trace, explained, rtol=1e-6)


def test_vectors_without_spread(spark):
    schema = "vec_id long, embedding array<float>"
    for rows in ([], [(1, None)], [(1, [1.0, 2.0])], [(1, [1.0, 2.0]), (2, [1.0, 2.0])]):
        df = spark.createDataFrame(rows, schema)
        model = whitening.fit_whitening(df)
        assert whitening.by_component(whitening.whiten(df, model), model).count() == 0


def test_whitening_query(spark):
    rows = llm_queries.op12_whitening(spark, "/root/testdata/sf0.01").collect()
    table = [(r["vec_id"], r["embedding"]) for r in spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet").collect()]
    ids, n, deviation, white, explained = _brute_whitening(table, 32)
    assert len(rows) == 32 * len(ids)
    by_key = {(r["vec_id"], r["component"]): r for r in rows}
    mine = np.array([[by_key[i, c + 1]["whitened"] for c in range(32)] for i in ids])
    sign = np.sign((mine * white).sum(axis=0))
    assert np.abs(mine * sign - white).max() < 1e-6
    assert all(by_key[i, 1]["deviation"] == d and by_key[i, 1]["n"] == n for i, d in zip(ids, deviation, strict=True))
    assert np.allclose([by_key[ids[0], c + 1]["explained"] for c in range(32)], explained, rtol=1e-9)
    assert max(r["identity_error"] for r in rows) < 1e-9
