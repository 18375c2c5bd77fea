import collections
import math
import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from countygeo.llm import jaccard_join, packing, secrets
from countygeo.llm import queries as llm_queries

from .test_joins import _brute_hits

TOKENIZER = Tokenizer.from_file(packing.vocabulary_path())


def _brute_pieces(rows, capacity):
    out = collections.Counter()
    for i, t in rows:
        ids = TOKENIZER.encode(t or "", add_special_tokens=False).ids + [packing.END_ID]
        for k in range(0, len(ids), capacity):
            part = ids[k:k + capacity]
            out[i, k // capacity, k, len(part), zlib.crc32(np.array(part, "<u4").tobytes())] += 1
    return out


def _check_places(rows, capacity):
    bins = collections.defaultdict(list)
    for r in rows:
        bins[r["sequence_id"]].append((r["offset"], r["length"]))
    for places in bins.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= capacity
    return len(bins)


@pytest.mark.parametrize("capacity", [16, 2048])
def test_pieces_and_places(spark, odd_docs, no_docs, capacity):
    extra = [(100, "zzq <|endoftext|>yyq ΑΣ ΟΔΟΣ İx　ab́c ́z don't I'LL 12ab3\x0bq"), (101, "Ünïcödé " * 50)]
    docs = odd_docs.select("doc_id", "text").where("doc_id IS NULL OR doc_id <> 6").unionAll(spark.createDataFrame(extra, "doc_id long, text string"))
    docs = docs.withColumns({"length": F.lit("clash"), "rank": F.lit(1)})
    got = packing.pack(docs, capacity=capacity).collect()
    expected = _brute_pieces([(r["doc_id"], r["text"]) for r in docs.collect()], capacity)
    assert collections.Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in got) == expected
    bins = _check_places(got, capacity)
    assert bins <= math.ceil(sum(r["length"] for r in got) / capacity) * 1.1 + 1
    assert packing.pack(no_docs).count() == 0


def test_kept_ids_decode_to_the_pieces(spark):
    docs = spark.createDataFrame([(1, "some words here, and there")], "doc_id long, text string")
    row = packing.pack(docs, keep_ids=True).first()
    assert np.frombuffer(row["ids"], "<u4").tolist() == TOKENIZER.encode("some words here, and there", add_special_tokens=False).ids + [0]


def test_chunks_encoded_together_as_alone(monkeypatch):
    path = packing.vocabulary_path()
    sign = packing._vocabulary(path).sign
    texts = pa.array([f"a b, c-d {k} x{k}y" for k in range(600)] + [None, "", f"{sign} a{sign}b {sign}{sign}", "\u3000", "İ\u3000ΟΔΟΣ <|endoftext|>"])
    ids, counts = packing.token_ids(texts, path)
    again = packing.token_ids(texts, path)
    assert (ids == again[0]).all() and (counts == again[1]).all()
    monkeypatch.setattr(packing, "TOGETHER", 1)
    packing._vocabulary.cache_clear()
    alone = packing.token_ids(texts, path)
    assert (ids == alone[0]).all() and (counts == alone[1]).all()
    assert ids.tolist() == sum((TOKENIZER.encode(t or "", add_special_tokens=False).ids for t in texts.to_pylist()), [])


@pytest.mark.parametrize("lengths", [(500, 1500), (900, 1100), (700, 1300, 1347)])
def test_plan_does_not_grow_with_equal_lengths(lengths):
    sizes = [len(packing.plan_bins(dict.fromkeys(lengths, n), 2048)) for n in (1000, 64_000)]
    assert max(sizes) <= 40
    bins = packing.plan_bins(dict.fromkeys(lengths, 1000), 2048)
    placed = collections.Counter()
    for items, n in bins:
        assert sum(items) <= 2048
        for x in items:
            placed[x] += n
    assert placed == dict.fromkeys(lengths, 1000)


def _optimum(items, capacity):
    """Fewest bins, by search over sorted bin contents."""
    items = tuple(sorted(items, reverse=True))
    best = len(items)

    def go(k, rooms):
        nonlocal best
        if len(rooms) >= best:
            return
        if k == len(items):
            best = len(rooms)
            return
        for room in sorted({r for r in rooms if r >= items[k]}):
            rest = list(rooms)
            rest.remove(room)
            go(k + 1, (*rest, room - items[k]))
        go(k + 1, (*rooms, capacity - items[k]))

    go(0, ())
    return best


def test_plan_places_every_item_and_the_reduction_is_safe():
    for seed in range(150):
        rnd = random.Random(seed)
        capacity = rnd.choice([10, 17, 30])
        items = [rnd.randint(1, capacity) for _ in range(rnd.randint(1, 9))]
        counts = collections.Counter(items)
        left = packing._Left(dict(counts))
        fixed = packing.dominant_bins(left, capacity)
        rest = list(collections.Counter(left.counts).elements())
        assert sum(n for _, n in fixed) + _optimum(rest, capacity) == _optimum(items, capacity)
        bins = packing.plan_bins(dict(counts), capacity)
        placed = collections.Counter()
        for lengths, n in bins:
            assert sum(lengths) <= capacity and n > 0
            for x in lengths:
                placed[x] += n
        assert placed == counts


def test_plan_of_many_items_is_small_and_tight():
    rnd = random.Random(1)
    counts = {n: rnd.randint(1, 10**7) for n in range(1, 2049)}
    bins = packing.plan_bins(counts)
    assert len(bins) < 20_000
    used = sum(n for _, n in bins)
    halves = sum(k for n, k in counts.items() if n > 1024)
    assert used <= 1.01 * max(halves, sum(n * k for n, k in counts.items()) / 2048) + 1
    assert packing.plan_bins({}) == []


def _documents(spark):
    rng = np.random.default_rng(6)
    text = [" ".join(rng.choice(["the", "and", "ofing", "thened", "onwh", "erst", "reed", "anly", "hein", "stou"], 60)) for _ in range(40)]
    item = " ".join(f"bench{k}" for k in range(20))
    rows = [(k, t, "en") for k, t in enumerate(text)]
    rows += [(100, text[0], "en"), (101, text[1] + " tail", "en"), (102, item + " " + text[2][:100], "en"), (103, "1234 !!", "en"), (104, None, None),
             (105, text[3] + ' token = "04dbebab91ab85687d33eeaaf9ac699e1188f962"', "en"), (None, " ".join(text[4:8]), "en")]
    docs = spark.createDataFrame([(*r, "src", len(r[1] or "")) for r in rows], "doc_id long, text string, lang string, source string, n_chars long")
    return docs, spark.createDataFrame([(1, item)], "item_id long, text string")


def test_every_stage_against_brute_force(spark, tmp_path):
    docs, bench = _documents(spark)
    bench.write.parquet(str(tmp_path / "benchmark.parquet"))
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    kept = docs
    for name, stage in corpus_pipeline.STAGES[:4]:
        before, kept = kept, stage(spark, kept, str(tmp_path)).cache()
        assert kept.columns == docs.columns, name
        a = {r["doc_id"]: r["text"] for r in before.collect()}
        b = {r["doc_id"]: r["text"] for r in kept.collect()}
        if name == "language_id":
            assert set(a) - set(b) == {103, 104}
        elif name == "ngram_jaccard_join":
            links = {r["doc_id"]: r["component_id"] for r in jaccard_join.jaccard_groups(before).collect()}
            assert set(b) - {None} == {k for k, v in links.items() if k is not None and v == k}
        elif name == "benchmark_decontamination":
            hits = _brute_hits([(k, t) for k, t in a.items()], [(1, bench.first()["text"])])
            assert set(b) == {k for k, v in hits.items() if not v[3]} and 102 not in b
        else:
            assert set(a) == set(b)
            assert all(not secrets.spans_of(t, secrets.KINDS, secrets.vocabulary_path()) for t in b.values())
            assert all(b[k] == t for k, t in a.items() if "token =" not in t)
    out = corpus_pipeline.run(spark, str(tmp_path)).collect()
    expected = _brute_pieces([(r["doc_id"], r["text"]) for r in kept.collect()], 2048)
    assert collections.Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in out) == expected
    _check_places(out, 2048)


def test_stages_take_odd_and_no_rows(spark, odd_docs, no_docs, tmp_path):
    _documents(spark)[1].write.parquet(str(tmp_path / "benchmark.parquet"))
    for docs in (odd_docs, no_docs):
        for name, stage in corpus_pipeline.STAGES:
            docs = stage(spark, docs, str(tmp_path)).cache()
            docs.count()
            assert name == corpus_pipeline.STAGES[-1][0] or docs.columns == no_docs.columns


def test_registered_names():
    names = list(llm_queries.queries())
    assert [n.split("_")[0] for n in names] == [f"op{k}" for k in range(1, 14)]
    assert set(llm_queries.oracle_sql()) <= set(names) and len(corpus_pipeline.STAGES) == 5
