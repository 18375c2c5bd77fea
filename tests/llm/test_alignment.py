import hashlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from sentencepiece import SentencePieceProcessor
from tokenizers import Tokenizer

from countygeo.llm import alignment
from countygeo.llm import queries as llm_queries

A_PATH, B_PATH = alignment.vocabulary_paths()
A = Tokenizer.from_file(A_PATH)
A.encode_special_tokens = True
B = SentencePieceProcessor(model_file=B_PATH)
NAMES = {i: t for t, i in A.get_vocab().items()}


def _a_bytes(i):
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    table, extra = {b: chr(b) for b in printable}, 0
    for b in range(256):
        if b not in table:
            table[b] = chr(256 + extra)
            extra += 1
    back = {c: b for b, c in table.items()}
    return bytes(back[c] for c in NAMES[i])


def _b_bytes(i):
    piece = B.id_to_piece(i)
    return bytes([int(piece[3:5], 16)]) if B.is_byte(i) else piece.replace("▁", " ").encode()


def _brute(rows):
    """Rows of the query, from whole texts and all pairs of occurrences."""
    links, parts = [], []
    for _, text in rows:
        mine, groups, ids = [], [], ([], [])
        if text:
            a, b = A.encode(" " + text, add_special_tokens=False).ids, B.encode(text)
            ab, bb = [_a_bytes(i) for i in a], [_b_bytes(i) for i in b]
            if b"".join(ab) == b"".join(bb) == (" " + text).encode():
                ids = (a, b)
                a_end, b_end = np.cumsum([len(x) for x in ab]).tolist(), np.cumsum([len(x) for x in bb]).tolist()
                at = {e: k for k, e in enumerate(a_end)}
                p = q = 0
                for j, e in enumerate(b_end):
                    if e in at:
                        mine.append((a[at[e]], b[j]))
                        groups.append(",".join(map(str, a[p:at[e] + 1])) + "|" + ",".join(map(str, b[q:j + 1])))
                        p, q = at[e] + 1, j + 1
        links.append(mine)
        parts.append((len(ids[0]), len(ids[1]), len(groups), hashlib.sha256(";".join(groups).encode()).hexdigest() if groups else ""))
    count = Counter(x for mine in links for x in mine)
    docs = Counter(x for mine in links for x in set(mine))
    highest = defaultdict(int)
    for (_, b), n in count.items():
        highest[b] = max(highest[b], n)
    out = Counter((i, *p, sum(count[x] == highest[x[1]] for x in mine), sum(count[x] for x in mine))
                  for (i, _), p, mine in zip(rows, parts, links, strict=True))
    return out, count, docs


def _rows(df):
    return Counter((r["doc_id"], r["n_a"], r["n_b"], r["n_groups"], r["groups_sha256"], r["n_best"], r["count_sum"]) for r in df.collect())


STRANGE = ["a▁b and more words", "x ▁", "tail ", "tail  ", " lead", "   ", " ", "a  b   c", "\tTab\r\nline  end \n", "\xa0 x\xa0  y", "café naïve  em  sp",
           "<|endoftext|> <s> </s> <unk> <0x41>", "don't I'LL we've 12 345,6", "　 wide　  space 中文 字", "\x1c x \x1d  y\x85 z", "ﬁ Å Å é", "\U0001f600 \U0001f468‍\U0001f469 ok",
           "def f(x):\n    return  x  # done"]


@pytest.mark.parametrize("limits", [(alignment.CONTAINER_BYTES, alignment.CONTAINER_ROWS), (60, 3)])
def test_alignment_against_brute_force(spark, odd_docs, no_docs, limits):
    extra = spark.createDataFrame([(100 + k, t) for k, t in enumerate(STRANGE)] + [(200 + k, "the same words again, the same") for k in range(50)],
                                  "doc_id long, text string")
    docs = odd_docs.select("doc_id", "text").unionAll(extra).withColumns({"a": F.lit("clash"), "place": F.lit(1), "container": F.lit(2)})
    expected, _, _ = _brute([(r["doc_id"], r["text"]) for r in docs.collect()])
    assert _rows(alignment.align_tokenizers(docs, container_bytes=limits[0], container_rows=limits[1])) == expected
    assert alignment.align_tokenizers(no_docs).count() == 0


def test_document_and_link_counts_of_pairs(spark):
    rows = [(k, t) for k, t in enumerate(["one two two two", "two", "two two three", None])]
    _, planes = alignment.inverted_pairs(spark.createDataFrame(rows, "doc_id long, text string"), container_rows=2)
    _, count, docs = _brute(rows)
    got = {(r["a"], r["b"]): (r["n_docs"], r["n_links"]) for r in alignment.pair_counts(planes).collect()}
    assert got == {x: (docs[x], count[x]) for x in count}


def test_random_texts_cut_into_chunks_as_whole():
    rng = np.random.default_rng(0)
    alphabet = list("ab   \xa0\t\né'.1 中  ")
    pair = alignment.Pair(A_PATH, B_PATH)
    texts = ["".join(rng.choice(alphabet, rng.integers(1, 30))) for _ in range(3000)]
    data, bounds = alignment._spaced(pa.array(texts))
    starts = np.append(alignment.chunk_starts(data, bounds), len(data))
    for k, t in enumerate(texts):
        cuts = starts[(starts >= bounds[k]) & (starts < bounds[k + 1])].tolist() + [int(bounds[k + 1])]
        parts = pair.align([bytes(data[p:q]) for p, q in zip(cuts, cuts[1:], strict=False)])
        whole = pair.align([(" " + t).encode()], joined=False)
        assert parts.ok.all() == whole.ok[0]
        if whole.ok[0]:
            assert whole.groups[0] == b"".join(parts.groups)
            codes = [parts.codes[f:f + n].tolist() for f, n in zip(parts.first_link, parts.n_links, strict=True)]
            assert whole.codes.tolist() == sum(codes, [])


def test_bitmaps_round_trip():
    rng = np.random.default_rng(1)
    members = [np.sort(rng.choice(n, k, replace=False)) for n, k in ((10, 1), (32_768, 20_000), (32_768, 3), (64, 64), (9000, 600))]
    sizes = np.array([len(m) for m in members])
    stored = alignment.packed_bitmaps(np.concatenate(members).astype(np.uint16), sizes)
    assert all(len(x.as_py()) <= 1 + 2 * len(m) and len(x.as_py()) <= 2 + m[-1] // 8 for x, m in zip(stored, members, strict=True))
    places, n = alignment.members_of(stored)
    assert n.tolist() == sizes.tolist() and (places == np.concatenate(members)).all()
    places, n = alignment.members_of(stored.slice(1, 3))
    assert (places == np.concatenate(members[1:4])).all() and n.tolist() == sizes[1:4].tolist()
    assert len(alignment.members_of(stored.slice(0, 0))[0]) == 0


def test_alignment_query(spark):
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()]
    got = llm_queries.op13_alignment(spark, "/root/testdata/sf0.001")
    assert _rows(got) == _brute(rows)[0] and got.where("n_links <> n_groups").count() == 0
