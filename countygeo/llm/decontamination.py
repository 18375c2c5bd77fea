"""Benchmark decontamination with suffix arrays over shards of the training texts (operator 7)."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from countygeo.llm.text import ALNUM, blocks, expand, free_name, long_list, mix, raw, segment_sum, words
from countygeo.runtime import broadcast_if_small, checkpoint

# Words of a window, and of the first words by which suffixes are chosen.
WINDOW, HEAD = 13, 4
# Benchmark words sent to the tasks at once; a larger benchmark takes several passes.
PASS_WORDS = 1_000_000
# Item ids of the documents that one output batch lists; a document of more is a batch of its own.
BATCH_ITEMS = 1_000_000
# A document is contaminated from this share of hit words: one in SHARE.
SHARE = 20

_SPAN = pa.struct([("s", pa.int32()), ("e", pa.int32())])


class Tests:
    """Distinct windows of some benchmark items, ready to be searched for.

    ``items`` holds (id, word hashes). Words are numbered from 1 by hash; 0
    stands for the end of a text and for words that no item has. The suffixes
    of the items that begin a window are kept in order, so a window is a range
    of them: what many items share is searched for once.
    """

    def __init__(self, items: list[tuple[str, np.ndarray]], window: int = WINDOW):
        self.window = window
        self.ids = [i for i, _ in items]
        sizes = np.array([len(h) for _, h in items], dtype=np.int64)
        self.hashes = np.concatenate([h for _, h in items])
        self.vocabulary = np.unique(self.hashes)
        ends = np.cumsum(sizes)
        counts = np.maximum(sizes - window + 1, 1)
        start = expand(ends - sizes, counts)
        item = np.repeat(np.arange(len(items)), counts)
        codes = self.codes(self.hashes)
        order = np.argsort(_suffix_ranks(codes, np.repeat(ends, sizes))[start], kind="stable")
        self.start, item = start[order], item[order]
        self.left = ends[item] - self.start
        rows = self._prefixes(codes, self.start, ends[item])
        fresh = np.concatenate([[True], (rows[1:] != rows[:-1]).any(axis=1)])
        self.first = np.flatnonzero(fresh)
        self.last = np.concatenate([self.first[1:], [len(rows)]])
        self.rows = rows[self.first]
        self.need = np.minimum(sizes[item[self.first]], window)
        pairs = np.unique((np.cumsum(fresh) - 1) * len(items) + item)
        self.holders = pairs % len(items)
        self.holder_end = np.cumsum(np.bincount(pairs // len(items), minlength=len(self.rows)))
        self.head = int(min(HEAD, self.need.min()))
        self.heads = np.unique(_join(self.rows[:, :self.head]))
        self.sieve = np.zeros(1 << 20, dtype=bool)
        self.sieve[self.vocabulary >> np.uint64(44)] = True

    def codes(self, hashes: np.ndarray) -> np.ndarray:
        at = np.minimum(np.searchsorted(self.vocabulary, hashes), len(self.vocabulary) - 1)
        return np.where(self.vocabulary[at] == hashes, at + 1, 0).astype(np.int32)

    def _prefixes(self, codes: np.ndarray, at: np.ndarray, end: np.ndarray) -> np.ndarray:
        """First ``window`` codes of the suffixes at ``at``, 0 from ``end`` on."""
        where = at[:, None] + np.arange(self.window)
        return np.where(where < end[:, None], codes[np.minimum(where, len(codes) - 1)], 0)

    def occurrences(self, hashes: np.ndarray, row_end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(word position, window number) of every occurrence; ``row_end`` is the end of each word's row.

        The suffix array leaves out suffixes whose first words start no window:
        no search could reach them. The rest is sorted by its first ``window``
        words, and all windows are searched at once, halving their ranges.
        """
        code = np.zeros(len(hashes), dtype=np.int32)
        known = np.flatnonzero(self.sieve[hashes >> np.uint64(44)])
        code[known] = self.codes(hashes[known])
        n = len(code) - self.head + 1
        if n <= 0:
            return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
        at = np.arange(n)
        for k in range(self.head):
            at = at[code[at + k] > 0]
        at = at[at + self.head <= row_end[at]]
        begin = _join(code[at[:, None] + np.arange(self.head)])
        slot = np.minimum(np.searchsorted(self.heads, begin), len(self.heads) - 1)
        at = at[self.heads[slot] == begin]
        if not len(at):
            return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
        suffix = self._prefixes(code, at, row_end[at])
        order = np.lexsort(suffix.T[::-1])
        at, suffix = at[order], suffix[order]
        low, high = self._bound(suffix, False), self._bound(suffix, True)
        found = high - low
        return at[expand(low, found)], np.repeat(np.arange(len(low)), found)

    def _bound(self, suffix: np.ndarray, upper: bool) -> np.ndarray:
        """First suffix whose needed words are not less (or are greater) than each window's."""
        low, high = np.zeros(len(self.rows), dtype=np.int64), np.full(len(self.rows), len(suffix), dtype=np.int64)
        column = np.arange(self.window)
        while (open_ := np.flatnonzero(low < high)).size:
            middle = (low[open_] + high[open_]) // 2
            differs = (suffix[middle] != self.rows[open_]) & (column < self.need[open_, None])
            first = differs.argmax(axis=1)
            less = np.where(differs.any(axis=1), suffix[middle, first] < self.rows[open_, first], upper)
            low[open_] = np.where(less, middle + 1, low[open_])
            high[open_] = np.where(less, high[open_], middle)
        return low

    def longest(self, hashes: np.ndarray, row_end: np.ndarray, at: np.ndarray, which: np.ndarray) -> np.ndarray:
        """Words of the longest verbatim match that begins at each occurrence, over all items that hold the window.

        The text from an occurrence on has its place among the ordered suffixes
        of its window; the longest match is with a neighbour of that place, and
        halving the range meets both.
        """
        low, high = self.first[which], self.last[which]
        below, above = self.need[which], self.need[which]  # words shared with the bounds of the range
        best = self.need[which]
        while (open_ := np.flatnonzero(low < high)).size:
            middle = (low[open_] + high[open_]) // 2
            a, test, left = at[open_], self.start[middle], self.left[middle]
            room = np.minimum(row_end[a] - a, left)
            length = self._common(hashes, a, test, np.minimum(below[open_], above[open_]), room)
            best[open_] = np.maximum(best[open_], length)
            stopped = length == room
            inner = np.where(stopped, 0, length)
            less = np.where(stopped, (length == left) & (a + length < row_end[a]), self.hashes[test + inner] < hashes[a + inner])
            low[open_] = np.where(less, middle + 1, low[open_])
            below[open_] = np.where(less, length, below[open_])
            high[open_] = np.where(less, high[open_], middle)
            above[open_] = np.where(less, above[open_], length)
        return best

    def _common(self, hashes: np.ndarray, at: np.ndarray, test: np.ndarray, known: np.ndarray, room: np.ndarray) -> np.ndarray:
        """Equal words of the texts at ``at`` and the items at ``test``, ``known`` of which are equal, ``room`` at most."""
        length = known.copy()
        active = np.flatnonzero(length < room)
        while len(active):
            k = length[active]
            active = active[hashes[at[active] + k] == self.hashes[test[active] + k]]
            length[active] += 1
            active = active[length[active] < room[active]]
        return length


def _suffix_ranks(codes: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Place of each suffix among the distinct ones, by doubling; ``end`` is the end of each word's item."""
    n, width, kinds = len(codes), 1, 0
    rank = np.unique(codes, return_inverse=True)[1] + 1
    while kinds < rank.max():
        kinds = rank.max()
        next_ = np.arange(n) + width
        rank = np.unique(rank * (n + 1) + np.where(next_ < end, rank[np.minimum(next_, n - 1)], 0), return_inverse=True)[1] + 1
        width *= 2
    return rank


def _join(codes: np.ndarray) -> np.ndarray:
    out = np.zeros(len(codes), dtype=np.uint64)
    for k in range(codes.shape[1]):
        out = mix(out + codes[:, k].astype(np.uint64) + np.uint64(1))
    return out


def _items_of_rows(tests: Tests, n: int, row: np.ndarray, which: np.ndarray,
                   limit: int = BATCH_ITEMS) -> Iterator[tuple[int, int, pa.Array]]:
    """(first, last, item ids of each) of runs of rows that list ``limit`` ids or so together, in row order."""
    count = len(tests.rows)
    pair = np.unique(row * count + which)
    row, which = pair // count, pair % count
    end = tests.holder_end[which]
    held = np.diff(tests.holder_end, prepend=0)[which]
    before = np.cumsum(held) - held
    of_row = np.searchsorted(row, np.arange(n + 1))  # first pair of each row
    lane = np.concatenate([before, [held.sum()]])[of_row[:-1]] // limit
    cuts = [*np.flatnonzero(np.diff(lane, prepend=-1)), n] if n else [0, 0]
    for first, last in pairwise(int(c) for c in cuts):
        a, b = of_row[first], of_row[last]
        # A row may hold several windows of one item.
        ids = len(tests.ids)
        owner = np.repeat(row[a:b] - first, held[a:b])
        item = np.unique(owner * ids + tests.holders[expand(end[a:b] - held[a:b], held[a:b])])
        names = pa.array(tests.ids, pa.string()).take(pa.array(item % ids))
        yield first, last, long_list(names, np.bincount(item // ids, minlength=last - first), pa.string())


def _search(tests: Tests):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in blocks(batches):
            n = batch.num_rows
            data, bounds = raw(batch.column("text"))
            hashed, _, _, row = words(data, bounds, ALNUM)
            size = np.bincount(row, minlength=n)
            end = np.cumsum(size)
            at, which = tests.occurrences(hashed, end[row])
            edge = np.zeros(len(hashed) + 1, dtype=np.int64)
            np.add.at(edge, at, 1)
            np.add.at(edge, at + tests.need[which], -1)
            hit = np.zeros(len(hashed) + 2, dtype=bool)
            hit[1:-1] = np.cumsum(edge[:-1]) > 0
            change = hit[1:] != hit[:-1]
            change[1:-1] |= hit[2:-1] & (row[1:] != row[:-1])
            cut = np.flatnonzero(change)
            s = cut[hit[cut + 1]]
            e = np.concatenate([cut[1:], cut[:0]])[hit[cut[:-1] + 1]] if len(cut) else cut
            owner = row[s]
            spans = pa.StructArray.from_arrays([pa.array((s - (end - size)[owner]).astype(np.int32)),
                                                pa.array((e - (end - size)[owner]).astype(np.int32))], fields=list(_SPAN))
            offsets = pa.array(np.concatenate([[0], np.cumsum(np.bincount(owner, minlength=n))]).astype(np.int32))
            longest = np.zeros(n, dtype=np.int64)
            np.maximum.at(longest, row[at], tests.longest(hashed, end[row], at, which))
            table = pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("text_key"), pa.array(size.astype(np.int64)),
                 pa.ListArray.from_arrays(offsets, spans), pa.array(longest)],
                ["doc_id", "text_key", "n_words", "spans", "longest_match"])
            for first, last, items in _items_of_rows(tests, n, row[at], which):
                part = table.slice(first, last - first)
                yield pa.RecordBatch.from_arrays([*part.columns[:4], items, part.column(4)],
                                                 ["doc_id", "text_key", "n_words", "spans", "items", "longest_match"])

    return run


def _word_hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in blocks(batches):
        data, bounds = raw(batch.column("text"))
        hashed, _, _, row = words(data, bounds, ALNUM)
        yield pa.RecordBatch.from_arrays(
            [batch.column("item_id"), long_list(hashed.view(np.int64), np.bincount(row, minlength=batch.num_rows))],
            ["item_id", "words"])


def test_passes(benchmark: DataFrame, item_id: str = "item_id", text: str = "text", window: int = WINDOW,
                pass_words: int = PASS_WORDS) -> Iterator[Tests]:
    """The benchmark in parts of about ``pass_words`` words, read one partition at a time."""
    items = benchmark.select(F.col(item_id).cast("string").alias("item_id"), F.col(text).alias("text"))
    rows = (items.where("item_id IS NOT NULL").mapInArrow(_word_hashes, "item_id string, words array<bigint>")
            .where(F.size("words") > 0))
    part, held = [], 0
    for found in rows.toLocalIterator():
        part.append((found["item_id"], np.array(found["words"], dtype=np.int64).view(np.uint64)))
        held += len(found["words"])
        if held >= pass_words:
            yield Tests(part, window)
            part, held = [], 0
    if part:
        yield Tests(part, window)


def _union_size(spans: Column) -> Column:
    """Words inside any of the spans."""
    start = F.struct(F.lit(0).cast("int").alias("end"), F.lit(0).cast("long").alias("n"))
    return F.aggregate(F.array_sort(spans), start, lambda acc, x: F.struct(
        F.greatest(acc["end"], x["e"]).alias("end"),
        (acc["n"] + F.greatest(F.lit(0), x["e"] - F.greatest(x["s"], acc["end"]))).cast("long").alias("n")), lambda acc: acc["n"])


def contamination(documents: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", text: str = "text",
                  item_id: str = "item_id", item_text: str = "text", window: int = WINDOW,
                  pass_words: int = PASS_WORDS) -> DataFrame:
    """Benchmark hits of each document.

    Columns: doc_id, text_key, n_words, n_hit (words inside an occurrence of any
    window of ``window`` item words; a shorter item is one window), n_items,
    items (their ids, sorted as strings), spans (hit word ranges, end exclusive),
    longest_match (words of the longest verbatim match) and contaminated.

    Each task sorts the suffixes of a block of documents and searches every
    distinct test window in it; the items of a window are named once a document. The test side is the stated query set: it is sent in passes of
    ``pass_words`` words, each a job over all documents, so a benchmark of any
    size fits. Words are ASCII letters and digits and everything outside ASCII,
    in lower case for A-Z, and compared by 64-bit hashes.

    Null texts have no words. Items with a null id, or without words, are left
    out; several items of one id count as one. Rows with the same id and text
    become one row; a null id is an id like any other. Columns of other names
    are ignored; empty tables give empty results or no hits.
    """
    docs = documents.select(F.col(doc_id).alias("doc_id"), F.xxhash64(text).alias("text_key"), F.col(text).alias("text"))
    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = (f"doc_id {kind}, text_key long, n_words long, spans array<struct<s:int,e:int>>, items array<string>, "
              "longest_match long")
    parts = []
    for tests in test_passes(benchmark, item_id, item_text, window, pass_words):
        found = docs.mapInArrow(_search(tests), schema)
        parts.append(checkpoint(found.where(F.size("spans") > 0) if parts else found))
    if not parts:
        nothing = Tests([("", np.zeros(1, dtype=np.uint64))], window)
        parts.append(docs.mapInArrow(_search(nothing), schema))
    every = parts[0]
    for part in parts[1:]:
        every = every.unionAll(part)
    return (every.groupBy("doc_id", "text_key")
            .agg(F.max("n_words").alias("n_words"), F.flatten(F.collect_set("spans")).alias("spans"),
                 F.array_sort(F.array_distinct(F.flatten(F.collect_set("items")))).alias("items"),
                 F.max("longest_match").alias("longest_match"))
            .withColumns({"n_hit": _union_size(F.col("spans")), "n_items": F.size("items").cast("long")})
            .withColumn("contaminated", (F.col("n_hit") > 0) & (SHARE * F.col("n_hit") >= F.col("n_words"))))


def decontaminate(documents: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The documents without contaminated ones; columns and repeated rows stay.

    Rows of one id are judged by their own texts. Null and empty texts stay;
    with an empty benchmark all rows do.
    """
    bad_id, bad_key = free_name(documents, "bad_id"), free_name(documents, "bad_key")
    bad = (contamination(documents, benchmark, doc_id, text).where("contaminated")
           .select(F.col("doc_id").alias(bad_id), F.col("text_key").alias(bad_key)))
    same = F.col(doc_id).eqNullSafe(F.col(bad_id)) & (F.xxhash64(text) == F.col(bad_key))
    return documents.join(broadcast_if_small(bad), same, "left_anti")
