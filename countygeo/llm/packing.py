"""Best-fit packing of tokenised documents after a dominance reduction (operator 4)."""

from __future__ import annotations

import bisect
import functools
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from countygeo.llm.text import blocks, expand
from countygeo.runtime import checkpoint

CAPACITY, END_ID = 2048, 0
VOCABULARY = "word_bpe_49k.json"
# Repeated chunks whose ids a worker keeps between blocks; others are encoded anew.
MEMORY_CHUNKS = 250_000
# Text bytes tokenised at once: more than elsewhere, so that a distinct chunk stands for more of its occurrences.
BYTES = 6_000_000
# Distinct chunks encoded as one string, and signs that may stand between them.
TOGETHER, SIGNS = 512, "♥★●■◆→•~^"
# Rows of one length that a task numbers, on average.
LANE_ROWS = 1024


def vocabulary_path(name: str = VOCABULARY) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class _Vocabulary:
    """The tokenizer, a sign that is one id of its own (None if it has none of SIGNS), and ids of chunks that were repeated."""

    def __init__(self, path: str):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        alone = {sign: self.tokenizer.encode(sign, add_special_tokens=False).ids for sign in SIGNS}
        self.sign, self.mark = next(((sign, ids[0]) for sign, ids in alone.items() if len(ids) == 1), (None, None))
        self.names = pa.array([], pa.large_string())
        self.ids, self.sizes = np.zeros(0, dtype="<u4"), np.zeros(0, dtype=np.int64)

    def remember(self, names: pa.Array, ids: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> None:
        self.names = pa.concat_arrays([self.names, names])
        self.ids = np.concatenate([self.ids, ids[expand(starts, sizes)]])
        self.sizes = np.concatenate([self.sizes, sizes])


@functools.lru_cache(maxsize=1)
def _vocabulary(path: str) -> _Vocabulary:
    return _Vocabulary(path)


def _chunk_ids(chunks: list[str], vocabulary: _Vocabulary) -> tuple[np.ndarray, np.ndarray]:
    """(ids of all chunks, ids of each). Many are encoded as one string, a sign between them, and cut where its id stands.

    A string that has the id elsewhere, or lacks it, is encoded chunk by chunk.
    """
    tokenizer, sign, mark = vocabulary.tokenizer, vocabulary.sign, vocabulary.mark
    together = TOGETHER if sign else 1
    groups = [chunks[at:at + together] for at in range(0, len(chunks), together)]
    encoded = tokenizer.encode_batch_fast([f" {sign} ".join(g) for g in groups], add_special_tokens=False)
    flat, sizes = [], []
    for group, one in zip(groups, encoded, strict=True):
        ids = np.array(one.ids, dtype="<u4")
        cuts = np.flatnonzero(ids == mark) if len(group) > 1 else np.zeros(0, dtype=np.int64)
        if len(cuts) == len(group) - 1:
            sizes.append(np.diff(np.concatenate([[-1], cuts, [len(ids)]])) - 1)
            flat.append(np.delete(ids, cuts))
        else:
            single = [np.array(x.ids, dtype="<u4") for x in tokenizer.encode_batch_fast(group, add_special_tokens=False)]
            sizes.append(np.array([len(x) for x in single], dtype=np.int64))
            flat += single
    return np.concatenate([*flat, np.zeros(0, dtype="<u4")]), np.concatenate([*sizes, np.zeros(0, dtype=np.int64)])


def token_ids(texts: pa.Array, path: str) -> tuple[np.ndarray, np.ndarray]:
    """(ids of all texts one after the other, ids of each text), without special tokens added.

    The vocabulary drops white space and no piece of it reaches across, so the
    ids of a text are those of its chunks between ASCII white space. Each
    distinct chunk of a block is encoded once, and those that occur again are
    kept for the blocks that follow.
    """
    chunks = pc.ascii_split_whitespace(pc.fill_null(texts, "").cast(pa.large_string()))
    if not isinstance(chunks, pa.Array):
        chunks = chunks.combine_chunks()
    per_text = np.diff(chunks.offsets.to_numpy())
    coded = chunks.flatten().dictionary_encode()
    names, code = coded.dictionary, coded.indices.to_numpy()
    vocabulary = _vocabulary(path)
    known = pc.fill_null(pc.index_in(names, value_set=vocabulary.names), -1).to_numpy(zero_copy_only=False)
    new, old = np.flatnonzero(known < 0), known >= 0
    new_ids, new_sizes = _chunk_ids(names.take(pa.array(new)).to_pylist(), vocabulary)
    pool = np.concatenate([vocabulary.ids, new_ids])
    start, sizes = np.empty(len(names), dtype=np.int64), np.empty(len(names), dtype=np.int64)
    sizes[old], sizes[new] = vocabulary.sizes[known[old]], new_sizes
    start[old] = (np.cumsum(vocabulary.sizes) - vocabulary.sizes)[known[old]]
    start[new] = len(vocabulary.ids) + np.cumsum(new_sizes) - new_sizes
    length = sizes[code]
    ids = pool[expand(start[code], length)]
    again = new[(np.bincount(code, minlength=len(names))[new] > 1) & (pc.binary_length(names).to_numpy()[new] <= 64)]
    again = again[:max(0, MEMORY_CHUNKS - len(vocabulary.names))]
    vocabulary.remember(names.take(pa.array(again)), pool, start[again], sizes[again])
    ends = np.concatenate([[0], np.cumsum(length)])
    bound = np.concatenate([[0], np.cumsum(per_text)])
    return ids, ends[bound[1:]] - ends[bound[:-1]]


def _pieces(path: str, capacity: int, keep: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in blocks(batches, limit=BYTES):
            ids, counts = token_ids(batch.column("text"), path)
            whole = np.insert(ids, np.cumsum(counts), np.uint32(END_ID)).astype("<u4")
            total = counts + 1
            pieces = -(-total // capacity)
            row = np.repeat(np.arange(len(total)), pieces)
            piece = expand(np.zeros(len(total), dtype=np.int64), pieces)
            length = np.minimum(capacity, total[row] - piece * capacity)
            first = (np.cumsum(total) - total)[row] + piece * capacity
            body = memoryview(whole.tobytes())
            parts = [body[4 * a:4 * (a + n)] for a, n in zip(first, length, strict=True)]
            columns = [batch.column("doc_id").take(pa.array(row)), pa.array(piece.astype(np.int32)), pa.array(piece * capacity),
                       pa.array(length), pa.array([zlib.crc32(p) for p in parts], pa.int64())]
            names = ["doc_id", "piece", "start", "length", "ids_crc32"]
            if keep:
                columns.append(pa.array([bytes(p) for p in parts], pa.binary()))
                names.append("ids")
            yield pa.RecordBatch.from_arrays(columns, names)

    return run


def token_pieces(documents: DataFrame, doc_id: str = "doc_id", text: str = "text", path: str | None = None,
                 capacity: int = CAPACITY, keep_ids: bool = False) -> DataFrame:
    """Pieces of at most ``capacity`` ids: doc_id, piece, start, length, ids_crc32 and, if wanted, the ids as bytes."""
    docs = documents.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.mapInArrow(_pieces(path or vocabulary_path(), capacity, keep_ids),
                           f"doc_id {kind}, piece int, start long, length long, ids_crc32 long" + ", ids binary" * keep_ids)


class _Left:
    """Lengths that still have items, in order, with their counts."""

    def __init__(self, counts: dict[int, int]):
        self.counts = {n: k for n, k in counts.items() if k > 0}
        self.lengths = sorted(self.counts)

    def take(self, length: int, n: int) -> None:
        self.counts[length] -= n
        if not self.counts[length]:
            del self.counts[length]
            self.lengths.pop(bisect.bisect_left(self.lengths, length))

    def most(self, room: int) -> int:
        """Greatest length that fits ``room``; 0 if none does."""
        at = bisect.bisect_right(self.lengths, room)
        return self.lengths[at - 1] if at else 0

    def best_pair(self, room: int) -> int:
        """Greatest sum of two or more items that fits ``room``, from above: exact for pairs, ``room`` if three fit."""
        if not self.lengths:
            return 0
        low = self.lengths[0]
        smallest = [low] * min(3, self.counts[low])
        for n in self.lengths[1:4]:
            smallest += [n] * min(3, self.counts[n])
        if len(smallest) > 2 and sum(sorted(smallest)[:3]) <= room:
            return room
        best, i, j = 0, 0, bisect.bisect_right(self.lengths, room) - 1
        while i <= j:
            total = self.lengths[i] + self.lengths[j]
            if total > room or i == j and self.counts[self.lengths[i]] < 2:
                j -= 1
                continue
            best = max(best, total)
            i += 1
        return best


def dominant_bins(left: _Left, capacity: int) -> list[tuple[tuple[int, ...], int]]:
    """Bins that some best packing holds, taken out of ``left``.

    For an item j, longest first, let k be the longest other item beside it. The
    bin {j, k} dominates every bin with j if k is at least as long as any two or
    more items that fit beside j together: exchanging these with k never needs
    more room. If nothing fits, {j} alone dominates. Both conclusions stay true
    for all further copies of j and k, since k stays the longest that fits and
    its rivals only become fewer: equal bins are counted, not listed.
    """
    fixed = []
    for length in sorted(left.counts, reverse=True):
        while left.counts.get(length):
            have = left.counts[length]
            left.take(length, 1)
            partner = left.most(capacity - length)
            rival = left.best_pair(capacity - length) if partner and partner < capacity - length else 0
            if partner == length:
                again = (left.counts[length] + 1) // 2
            else:
                again = min(have, left.counts.get(partner, have))
            if not partner:
                fixed.append(((length,), have))
                if have > 1:
                    left.take(length, have - 1)
            elif partner >= rival:
                left.take(partner, again)
                if again > 1:
                    left.take(length, again - 1)
                fixed.append(((length, partner), again))
            else:
                left.counts[length] = left.counts.get(length, 0) + 1
                if left.counts[length] == 1:
                    bisect.insort(left.lengths, length)
                break
    return fixed


def best_fit(left: _Left, capacity: int) -> list[tuple[tuple[int, ...], int]]:
    """Best-fit-decreasing bins of the lengths in ``left``, with how often each occurs.

    Equal bins are one entry: all items of a length go to the fullest kinds of
    bins that have room, each opened kind split at most once a length.
    """
    kinds: list[list[tuple[tuple[int, ...], int]]] = [[] for _ in range(capacity + 1)]
    for length in sorted(left.counts, reverse=True):
        n = left.counts[length]
        room = length
        while n and room <= capacity:
            if not kinds[room]:
                room += 1
                continue
            bin_, count = kinds[room].pop()
            fits = room // length
            # The fullest bin stays the fullest until it is full, so it takes as many as fit.
            used, rest = (count, 0) if n >= fits * count else divmod(n, fits)
            if used:
                kinds[room - fits * length].append((bin_ + (length,) * fits, used))
            if rest:
                kinds[room - rest * length].append((bin_ + (length,) * rest, 1))
            if count > used + (rest > 0):
                kinds[room].append((bin_, count - used - (rest > 0)))
            n -= used * fits + rest
        fits = capacity // length
        full, rest = divmod(n, fits)
        if full:
            kinds[capacity - fits * length].append(((length,) * fits, full))
        if rest:
            kinds[capacity - rest * length].append(((length,) * rest, 1))
    return [k for room in kinds for k in room]


def plan_bins(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[tuple[int, ...], int]]:
    """(lengths in a bin, how many such bins) for all items of a length histogram."""
    left = _Left(counts)
    return dominant_bins(left, capacity) + best_fit(left, capacity)


def _seats(bins: list[tuple[tuple[int, ...], int]]) -> list[tuple[int, int, int, int]]:
    """Ranges of equal places, by rank within a length: (length, first rank, first sequence, offset)."""
    taken: dict[int, int] = {}
    seats, sequence = [], 0
    for lengths, count in bins:
        offset = 0
        for length in lengths:
            rank = taken.get(length, 0)
            seats.append((length, rank, sequence, offset))
            taken[length] = rank + count
            offset += length
        sequence += count
    return seats


def _ranked(pieces: DataFrame) -> DataFrame:
    """``rank`` of each piece among those of its length, from 0, without a task per length.

    Rows are numbered inside (length, lane), where lanes hold about LANE_ROWS
    rows of a length, and the lanes before are added.
    """
    counts = pieces.groupBy("length").agg(F.ceil(F.count("*") / LANE_ROWS).cast("int").alias("lanes"))
    laned = pieces.join(F.broadcast(counts), "length").withColumn(
        "lane", F.pmod(F.xxhash64("doc_id", "piece"), F.col("lanes")).cast("int")).drop("lanes")
    before = W.partitionBy("length").orderBy("lane").rowsBetween(W.unboundedPreceding, -1)
    lanes = laned.groupBy("length", "lane").agg(F.count("*").alias("n")).select(
        "length", "lane", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    inside = F.row_number().over(W.partitionBy("length", "lane").orderBy("doc_id", "piece"))
    return (laned.withColumn("__inside", inside - 1).join(lanes, ["length", "lane"])
            .withColumn("rank", F.col("before") + F.col("__inside")).drop("__inside", "before", "lane"))


def pack(documents: DataFrame, doc_id: str = "doc_id", text: str = "text", path: str | None = None,
         capacity: int = CAPACITY, keep_ids: bool = False) -> DataFrame:
    """Pieces of all documents with the sequence and offset at which each is placed.

    Only the histogram of lengths, ``capacity`` rows at most, reaches the driver.
    There the dominance reduction fixes what it can and best fit decreasing
    places the rest, over all documents at once and in kinds of bins, so the plan
    does not grow with the corpus. Pieces are numbered inside their length and
    each takes the place of its number.

    Null and empty texts are one piece of the end id. Repeated rows are pieces
    of their own. Columns of other names are ignored; an empty table gives no
    rows.
    """
    pieces = checkpoint(token_pieces(documents, doc_id, text, path, capacity, keep_ids))
    counts = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}
    places: dict[int, list[tuple[int, int, int]]] = {}
    for length, first, sequence, offset in _seats(plan_bins(counts, capacity)):
        places.setdefault(length, []).append((first, sequence, offset))
    return _place(_ranked(pieces), {n: np.array(rows, dtype=np.int64).T for n, rows in places.items()})


def _place(ranked: DataFrame, seats: dict[int, np.ndarray]) -> DataFrame:
    columns = [c for c in ranked.columns if c != "rank"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length, rank = batch.column("length").to_numpy(), batch.column("rank").to_numpy()
            sequence, offset = np.zeros(len(rank), dtype=np.int64), np.zeros(len(rank), dtype=np.int64)
            for n in np.unique(length):
                at = np.flatnonzero(length == n)
                first, starts, offsets = seats[int(n)]
                seat = np.searchsorted(first, rank[at], side="right") - 1
                sequence[at] = starts[seat] + rank[at] - first[seat]
                offset[at] = offsets[seat]
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in columns], pa.array(sequence), pa.array(offset)],
                                             [*columns, "sequence_id", "offset"])

    schema = ", ".join(f"`{c}` {ranked.schema[c].dataType.simpleString()}" for c in columns) + ", sequence_id long, offset long"
    return ranked.mapInArrow(run, schema)
