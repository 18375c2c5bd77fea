import collections
import itertools
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from countygeo.llm import decontamination as dc
from countygeo.llm import jaccard_join as jj
from countygeo.llm.embedding_dedup import linked, near_vectors, unit

from .conftest import find_words


def _merge(low, a, b):
    while low[a] != a:
        a = low[a]
    while low[b] != b:
        b = low[b]
    low[max(a, b)] = min(a, b)


def _low(low, a):
    while low[a] != a:
        a = low[a]
    return a


def _vectors():
    rng = np.random.default_rng(5)
    base = rng.normal(size=(40, 16))
    near = [base[k] + rng.normal(scale=s, size=16) for k in range(12) for s in (0.02, 0.05, 0.08, 0.2)]
    rows = [(k, [float(v) for v in x], int(k % 3 == 0)) for k, x in enumerate(np.vstack([base, near, base[:6], 3 * base[:2]]))]
    n = len(rows)
    rows += [(n, None, 1), (n + 1, [], 1), (n + 2, [0.0] * 16, 1), (n + 3, [float("nan")] * 16, 1), (n + 4, [float("inf")] + [1.0] * 15, 1),
             (n + 5, [None] + [1.0] * 15, 1), (n + 6, rows[0][1], None), (None, rows[0][1], 1), (n + 7, [1.0, 2.0], 1), rows[3]]
    return rows


def _brute_vectors(rows, threshold):
    ids = sorted({r[0] for r in rows if r[0] is not None})
    by_id = {r[0]: r for r in rows if r[0] is not None}
    low, links = {i: i for i in ids}, collections.Counter()
    usable = [i for i in ids if by_id[i][2] is not None and by_id[i][1] and None not in by_id[i][1]
              and np.isfinite(by_id[i][1]).all() and any(by_id[i][1])]
    for a, b in itertools.combinations(usable, 2):
        x, y = np.array(by_id[a][1]), np.array(by_id[b][1])
        if by_id[a][2] == by_id[b][2] and len(x) == len(y) and x @ y / np.linalg.norm(x) / np.linalg.norm(y) >= threshold:
            links[a] += 1
            links[b] += 1
            _merge(low, a, b)
    return {i: (links[i], _low(low, i), _low(low, i) == i) for i in ids}


@pytest.mark.parametrize("tile", [4, 1024])
def test_near_vectors_equal_brute_force(spark, tile):
    rows = _vectors()
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").withColumn("rep", F.lit("clash"))
    got = near_vectors(table, tile=tile).collect()
    assert {r["vec_id"]: (r["n_links"], r["component_id"], r["kept"]) for r in got if r["vec_id"] is not None} == _brute_vectors(rows, 0.98)
    assert [(r["n_links"], r["component_id"], r["kept"]) for r in got if r["vec_id"] is None] == [(0, None, True)]
    assert len(got) == len(set(r[0] for r in rows))
    assert near_vectors(table.limit(0)).count() == 0


def test_bounds_never_miss_a_pair():
    rng = np.random.default_rng(1)
    x = unit(rng.normal(size=(200, 24)))
    y = unit(np.vstack([x[:100] + rng.normal(scale=0.04, size=(100, 24)), rng.normal(size=(50, 24))]))
    for threshold in (0.5, 0.95, 0.98):
        assert (linked(x, y, threshold) == (x @ y.T >= threshold)).all()


def _texts():
    rng = np.random.default_rng(9)
    vocabulary = [f"w{k}" for k in range(400)]
    rows = []
    for size in (1, 2, 3, 5, 9, 12, 20, 40, 90, 200):
        base = list(rng.choice(vocabulary, size))
        for edits in (0, 0, 1, 1, 2, 3, size // 12, size // 8):
            words = list(base)
            for _ in range(edits):
                words[int(rng.integers(size))] = str(rng.choice(vocabulary))
            rows.append(" ".join(words))
    rows += [None, "", "  ", "W1  w2\tW3", "w1 w2 w3", "a b", "A B", "a b c d"]
    return [(k, t) for k, t in enumerate(rows)]


def _brute_texts(rows):
    sets = {}
    for i, t in rows:
        w = find_words(t, r"[^\x20\x09-\x0D]+")
        sets[i] = {tuple(w[k:k + 3]) for k in range(max(1, len(w) - 2))} if w else set()
    low, links = {i: i for i in sets}, collections.Counter()
    for a, b in itertools.combinations(sets, 2):
        both = len(sets[a] & sets[b])
        if sets[a] and sets[b] and 100 * both >= 90 * (len(sets[a]) + len(sets[b]) - both):
            links[a] += 1
            links[b] += 1
            _merge(low, a, b)
    return {i: (len(sets[i]), _low(low, i), links[i]) for i in sets}


@pytest.mark.parametrize("tile", [2, 256])
def test_jaccard_groups_equal_brute_force(spark, tile):
    rows = _texts()
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("n_shingles", F.lit("clash"))
    got = jj.jaccard_groups(docs, tile=tile).collect()
    expected = _brute_texts(rows)
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"], r["n_links"]) for r in got} == expected
    kept = {r["doc_id"] for r in jj.first_of_groups(docs).collect()}
    assert kept == {i for i, v in expected.items() if v[1] == i}


def test_signatures_of_linked_sets_meet():
    rng = np.random.default_rng(2)
    for size in (10, 11, 19, 37, 80, 150, 700):
        for population, near in ((10, None), (10**9, None)):
            plan = {b: jj.allocation(b, population) for b in range(80)}
            for _ in range(30):
                a = np.unique(rng.integers(0, 2**63, size).astype(np.uint64) * np.uint64(2))
                b = a.copy()
                while True:
                    c = b.copy()
                    c[int(rng.integers(len(c)))] = rng.integers(0, 2**63)
                    c = np.unique(c[1:] if rng.random() < 0.3 else c)
                    both = len(np.intersect1d(a, c))
                    if 100 * both < 90 * (len(a) + len(c) - both):
                        break
                    b = c
                if len(b) != len(a) or (b != a).any():
                    assert len(np.intersect1d(jj.signatures(a, plan), jj.signatures(b, plan)))


@pytest.mark.parametrize("population", [10, 10**5, 10**6, 10**7, 10**9, 10**12])
def test_signatures_of_linked_sets_meet_when_segments_are_empty(population):
    rng = np.random.default_rng(4)
    for size in (10, 11, 12, 13, 16, 20, 25, 31):
        band = jj.band_of(size)
        count, near = jj.allocation(band, population)
        low, high = (int(x) for x in jj.band_starts(jj.PERCENT)[band:band + 2])

        def place(segment, count=count):  # a shingle in each of these segments
            return ((segment * 2**64 + 2**63) // count + int(rng.integers(2**40))) if count else 0

        for _ in range(300):
            filled = rng.permutation(count)[:rng.integers(max(1, count - 2), count + 1)]
            both = [place(int(rng.choice(filled))) for _ in range(int(rng.integers(low - 1, size + 1)))]
            differ = [place(int(rng.integers(count))) for _ in range(int(rng.integers(1, jj.distance(high - 1) + 1)))]
            side = rng.random(len(differ)) < 0.5
            a, b = (np.unique(np.array(both + [d for d, s in zip(differ, side, strict=True) if s == k], dtype=np.uint64)) for k in (True, False))
            shared = len(np.intersect1d(a, b))
            if min(len(a), len(b)) and 100 * shared >= 90 * (len(a) + len(b) - shared) and band in (jj.band_of(len(a)), jj.band_of(len(a)) + 1):
                if band in (jj.band_of(len(b)), jj.band_of(len(b)) + 1):
                    assert len(np.intersect1d(jj.signatures(a, {band: (count, near)}), jj.signatures(b, {band: (count, near)})))


def test_neighbourhoods_are_chosen_when_segments_are_short():
    assert jj.allocation(jj.band_of(12), 10**9)[1] > 0
    assert jj.allocation(jj.band_of(500), 1000)[1] == 0
    assert jj.allocation(jj.band_of(5), 10**9) == (0, 0)


def test_jaccard_odd_rows(spark, odd_docs, no_docs):
    got = jj.jaccard_groups(odd_docs).collect()
    assert len(got) == len({(r["doc_id"], r["n_shingles"]) for r in got}) == 11
    for r in got:
        assert r["component_id"] == r["doc_id"] and r["n_links"] == 0
    assert jj.first_of_groups(odd_docs).count() == odd_docs.count()
    assert jj.first_of_groups(odd_docs).columns == odd_docs.columns
    assert jj.jaccard_groups(no_docs).count() == 0


def _brute_hits(docs, items, window=13):
    pattern = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
    wanted = collections.defaultdict(set)
    for i, t in items:
        w = find_words(t, pattern)
        if w and i is not None:
            m = min(window, len(w))
            for k in range(len(w) - m + 1):
                wanted[tuple(w[k:k + m])].add(str(i))
    out = {}
    for i, t in docs:
        w, hit, found = find_words(t, pattern), set(), set()
        for m in {len(k) for k in wanted}:
            for k in range(len(w) - m + 1):
                if tuple(w[k:k + m]) in wanted:
                    hit.update(range(k, k + m))
                    found |= wanted[tuple(w[k:k + m])]
        out[i] = (len(w), len(hit), sorted(found), bool(hit) and 20 * len(hit) >= len(w))
    return out


def _benchmark_case():
    rng = np.random.default_rng(4)
    vocabulary = [f"t{k}" for k in range(30)]
    items = [(k, " ".join(rng.choice(vocabulary, n))) for k, n in enumerate((20, 20, 13, 14, 5, 2, 40, 12))]
    items += [(100, None), (101, "!!"), (102, items[0][1].upper()), (None, "t1 t2"), (103, "École, 中")]
    docs = []
    for k in range(40):
        w = list(rng.choice(vocabulary, int(rng.integers(1, 120))))
        source = (items[k % 8][1] or "").split()
        at, cut = int(rng.integers(len(w))), int(rng.integers(0, 3))
        docs.append((k, " -- ".join(w[:at] + source[cut:] + w[at:])))
    docs += [(200, None), (201, ""), (202, "École—中"), (203, "an ÉCOLE: École 4 中; École 中"), (204, "t1")]
    return docs, items


@pytest.mark.parametrize("pass_words", [30, 1_000_000])
def test_contamination_equals_brute_force(spark, pass_words):
    docs, items = _benchmark_case()
    table = spark.createDataFrame(docs, "doc_id long, text string").withColumn("items", F.lit(1))
    bench = spark.createDataFrame(items, "item_id long, text string").withColumn("words", F.lit(1))
    got = dc.contamination(table, bench, pass_words=pass_words).collect()
    expected = _brute_hits(docs, items)
    assert {r["doc_id"]: (r["n_words"], r["n_hit"], r["items"], r["contaminated"]) for r in got} == expected
    kept = dc.decontaminate(table, bench)
    assert kept.columns == table.columns
    assert {r["doc_id"] for r in kept.collect()} == {i for i, v in expected.items() if not v[3]}


def test_longest_match_goes_on_past_the_window(spark):
    item = " ".join(f"k{k}" for k in range(30))
    text = "a b " + " ".join(f"k{k}" for k in range(5, 25)) + " z"
    docs, bench = spark.createDataFrame([(1, text)], "doc_id long, text string"), spark.createDataFrame([(1, item)], "item_id long, text string")
    row = dc.contamination(docs, bench).first()
    assert (row["longest_match"], row["n_hit"], [tuple(s) for s in row["spans"]]) == (20, 20, [(2, 22)])


def _tests_of(texts, vocabulary):
    return dc.Tests([(str(k), vocabulary[np.array(t)]) for k, t in enumerate(texts)], window=4)


def test_windows_are_distinct_and_longest_matches_equal_brute_force():
    rng = np.random.default_rng(11)
    vocabulary = rng.integers(0, 2 ** 63, 4, dtype=np.uint64)
    for _ in range(60):
        items = [rng.integers(0, 3, int(rng.integers(1, 14))).tolist() for _ in range(12)]
        tests = _tests_of(items, vocabulary)
        windows = {tuple(t[k:k + 4]) for t in items for k in range(max(len(t) - 3, 1))}
        assert len(tests.rows) == len(windows)
        text = rng.integers(0, 4, 60)
        row_end = np.where(np.arange(60) < 31, 31, 60)
        hashes = vocabulary[text]
        at, which = tests.occurrences(hashes, row_end)
        got = dict(zip(zip(at.tolist(), tests.need[which].tolist()), tests.longest(hashes, row_end, at, which).tolist()))
        assert len(got) == len(at)
        expected = {}
        for p in range(60):
            for t in items:
                for k in range(max(len(t) - 3, 1)):
                    need, n = min(4, len(t)), 0
                    while p + n < row_end[p] and k + n < len(t) and text[p + n] == t[k + n]:
                        n += 1
                    if n >= need:
                        expected[p, need] = max(n, expected.get((p, need), 0))
        assert got == expected
        found = {(int(p), tests.ids[h]) for p, w in zip(at, which)
                 for h in tests.holders[(tests.holder_end[w - 1] if w else 0):tests.holder_end[w]]}
        assert found == {(p, str(j)) for p in range(60) for j, t in enumerate(items) for k in range(max(len(t) - 3, 1))
                         if (m := min(4, len(t))) <= row_end[p] - p and text[p:p + m].tolist() == t[k:k + m]}


def test_listed_items_do_not_depend_on_the_batch():
    rng = np.random.default_rng(12)
    vocabulary = rng.integers(0, 2 ** 63, 4, dtype=np.uint64)
    tests = _tests_of([rng.integers(0, 3, 9).tolist() for _ in range(12)], vocabulary)
    row, which = rng.integers(0, 20, 70), rng.integers(0, len(tests.rows), 70)

    def all_items(limit, n=25):
        runs = list(dc._items_of_rows(tests, n, row, which, limit))
        assert [a for a, _, _ in runs] == [0, *(b for _, b, _ in runs)][:-1] and runs[-1][1] == n
        return [x for _, _, items in runs for x in items.to_pylist()]

    assert all_items(1) == all_items(7) == all_items(1_000_000)


def test_a_window_of_many_items_found_many_times(spark):
    preamble = " ".join(f"p{k}" for k in range(13))
    items = spark.range(20_000).selectExpr("id AS item_id", f"concat('{preamble} tail', id) AS text")
    rows = [(1, f"{preamble} x " * 10_000)] + [(k, f"{preamble} tail{k} end") for k in range(2, 40)]
    start = time.monotonic()
    got = {r["doc_id"]: r for r in dc.contamination(spark.createDataFrame(rows, "doc_id long, text string"), items)
           .select("doc_id", "n_words", "n_hit", "n_items", "longest_match").collect()}
    assert time.monotonic() - start < 60
    assert tuple(got[1]) == (1, 140_000, 130_000, 20_000, 13)
    assert all(tuple(got[k])[2:] == (14, 20_000, 14) for k in range(2, 40))


def test_contamination_odd_rows(spark, odd_docs, no_docs):
    bench = spark.createDataFrame([(1, "word word word word word word word word word word word word word")], "item_id long, text string")
    got = {(r["doc_id"]): (r["n_words"], r["n_hit"]) for r in dc.contamination(odd_docs, bench).collect()}
    assert got[1] == got[2] == got[3] == (0, 0) and got[5] == (30_000, 30_000) and len(got) == 11
    assert dc.decontaminate(odd_docs, bench).count() == odd_docs.count() - 1
    nothing = bench.limit(0)
    assert not any(r["contaminated"] for r in dc.contamination(odd_docs, nothing).collect())
    assert dc.contamination(no_docs, bench).count() == 0
