import re

import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from countygeo.llm.graph import components, local_roots
from countygeo.llm.text import ALNUM, LETTERS, VISIBLE, blocks, code_points, raw, words

from .conftest import find_words

PATTERNS = [(ALNUM, r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"), (VISIBLE, r"[^\x20\x09-\x0D]+"), (LETTERS, r"[^\x00-\x60\x7B-\x7F]+")]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.one_of(st.none(), st.text(alphabet="aBz9 .-é中\n\x0b ", max_size=30)), min_size=1, max_size=6))
def test_words_are_the_pattern_matches(texts):
    data, bounds = raw(pa.array(texts, pa.string()))
    for table, pattern in PATTERNS:
        hashed, start, end, row = words(data, bounds, table)
        expected = [(k, w) for k, t in enumerate(texts) for w in find_words(t, pattern)]
        got = [(int(r), bytes(data[a:b]).decode().translate(str.maketrans("B", "b"))) for r, a, b in zip(row, start, end, strict=True)]
        assert got == expected
        by_word = {}
        for h, (_, w) in zip(hashed, got, strict=True):
            assert by_word.setdefault(w, h) == h
        assert len(set(by_word.values())) == len(by_word)


def test_code_points_count_characters():
    texts = ["éé ab", "", "\U0001f600 cd"]
    data, bounds = raw(pa.array(texts))
    _, start, end, row = words(data, bounds, LETTERS)
    got = [texts[r][a:b] for r, a, b in zip(row, code_points(data, bounds, row, start), code_points(data, bounds, row, end), strict=True)]
    assert got == [w for t in texts for w in re.findall(r"\S+", t)]


def test_blocks_keep_every_row_in_order():
    batch = pa.RecordBatch.from_arrays([pa.array(range(6)), pa.array(["a" * 9, None, "b" * 30, "", "c", "d"])], ["k", "text"])
    parts = list(blocks(iter([batch]), limit=10))
    assert [k for p in parts for k in p.column("k").to_pylist()] == list(range(6))
    assert max(p.num_rows for p in parts) < 6


def test_components_of_chains_stars_and_loops(spark):
    rng = np.random.default_rng(3)
    chain = [(k, k + 1) for k in range(100, 140)]
    star = [(200, k) for k in range(201, 260)]
    pairs = chain + star + [(7, 7), (None, 3), (5, None), (9, 8), (8, 9)] + [tuple(map(int, p)) for p in rng.integers(300, 400, (60, 2))]
    low = {x: x for p in pairs if None not in p and p[0] != p[1] for x in p}
    moved = True
    while moved:
        moved = False
        for a, b in pairs:
            if a in low and b in low and low[a] != low[b]:
                low[a] = low[b] = min(low[a], low[b])
                moved = True
    edges = spark.createDataFrame(pairs, "a long, b long")
    assert {r["node"]: r["component"] for r in components(edges).collect()} == low
    assert components(edges.limit(0)).count() == 0


def test_local_roots_follow_links():
    links = np.zeros((6, 6), dtype=bool)
    for a, b in ((1, 2), (2, 5), (3, 4)):
        links[a, b] = links[b, a] = True
    assert local_roots(links).tolist() == [0, 1, 1, 3, 3, 1]
