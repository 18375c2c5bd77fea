"""Alignment of two tokenizers by inverted bitmaps of token pairs (operator 13)."""

from __future__ import annotations

import functools
import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from countygeo.llm.text import expand, raw
from countygeo.runtime import broadcast_if_small, checkpoint

BYTE_BPE, PIECES = "byte_bpe_50k.json", "piece_bpe_32k.model"
# A container of bitmaps: rows until their texts hold so many bytes, and at most so many rows.
CONTAINER_BYTES, CONTAINER_ROWS = 8_000_000, 32_768
# Text bytes cut into chunks and looked up at once.
PART_BYTES = 4_000_000
# Bytes of chunks that are tokenised as one string.
JOINED_BYTES = 16_384
# Shift of an A id in a pair; B ids are below 2**20.
PAIR = 1 << 20
# First byte of a stored bitmap: a list of places, or bits.
PLACES, BITS = 0, 1


def vocabulary_paths() -> tuple[str, str]:
    import public_tokenizers

    return public_tokenizers.path(BYTE_BPE), public_tokenizers.path(PIECES)


def _byte_of_character() -> dict[str, int]:
    """Byte-level alphabet: printable bytes are themselves, the others follow from code point 256 on."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in set(printable)]
    return {chr(b): b for b in printable} | {chr(256 + k): b for k, b in enumerate(others)}


def _ragged(parts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(all bytes, first byte of each part, bytes of each part)."""
    size = np.array([len(p) for p in parts], dtype=np.int64)
    return np.frombuffer(b"".join(parts), dtype=np.uint8), np.cumsum(size) - size, size


@dataclass
class Aligned:
    """Alignments of texts: ``ok`` where bytes agree, counts, the pair codes of the links, and the groups as text."""

    ok: np.ndarray
    n_a: np.ndarray
    n_b: np.ndarray
    n_links: np.ndarray
    first_link: np.ndarray
    codes: np.ndarray
    groups: np.ndarray

    @staticmethod
    def empty(n: int) -> Aligned:
        return Aligned(np.zeros(n, dtype=bool), *(np.zeros(n, dtype=np.int64) for _ in range(4)), np.zeros(0, dtype=np.int64),
                       np.full(n, b"", dtype=object))

    def put(self, at: np.ndarray, other: Aligned) -> None:
        """Take the alignments of ``other`` for the texts ``at``."""
        other.first_link = other.first_link + len(self.codes)
        for name in ("ok", "n_a", "n_b", "n_links", "first_link", "groups"):
            getattr(self, name)[at] = getattr(other, name)
        self.codes = np.concatenate([self.codes, other.codes])


class Pair:
    """Both tokenizers, with the bytes and the decimal digits of every id."""

    def __init__(self, a_path: str, b_path: str):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from sentencepiece import SentencePieceProcessor
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(a_path)
        self.a.encode_special_tokens = True
        self.b = SentencePieceProcessor(model_file=b_path)
        alphabet = _byte_of_character()
        names = {i: token for token, i in self.a.get_vocab(with_added_tokens=True).items()}
        self.a_bytes = _ragged([bytes(alphabet[c] for c in names[i]) if i in names and all(c in alphabet for c in names[i]) else b""
                                for i in range(max(names) + 1)])
        self.b_bytes = _ragged([bytes([int(self.b.id_to_piece(i)[1:-1], 16)]) if self.b.is_byte(i)
                                else self.b.id_to_piece(i).replace("▁", " ").encode() for i in range(self.b.get_piece_size())])
        self.digits = _ragged([str(i).encode() for i in range(max(len(self.a_bytes[1]), len(self.b_bytes[1])))])

    def align(self, texts: list[bytes], joined: bool = True) -> Aligned:
        """Alignment of each text; all begin with a space, which B adds to its own.

        Texts that can stand before another without changing its tokens are
        tokenised many in one string, and cut again by bytes. If the bytes of
        such a string differ, its texts are taken one by one.
        """
        strings: list[list[int]] = []
        size = JOINED_BYTES
        for k, text in enumerate(texts):
            if not joined or text[-1] <= 32 or text[-1] >= 128 and text.decode()[-1].isspace() or "▁".encode() in text:
                strings.insert(0, [k])
            elif size >= JOINED_BYTES:
                strings.append([k])
                size = len(text)
            else:
                strings[-1].append(k)
                size += len(text)
        bodies = [b"".join([texts[k] for k in owner]) for owner in strings]
        a = [np.array(x.ids, dtype=np.int64) for x in self.a.encode_batch_fast([t.decode() for t in bodies], add_special_tokens=False)]
        b = [np.array(y, dtype=np.int64) for y in self.b.encode([t[1:].decode() for t in bodies], num_threads=1)]
        good = [_spell(x, self.a_bytes) == t == _spell(y, self.b_bytes) for x, y, t in zip(a, b, bodies, strict=True)]
        out = Aligned.empty(len(texts))
        kept = [k for k, g in enumerate(good) if g]
        if kept:
            at = np.array([i for k in kept for i in strings[k]])
            out.put(at, self._cut(np.concatenate([a[k] for k in kept]), np.concatenate([b[k] for k in kept]),
                                  np.array([len(texts[i]) for i in at])))
        again = [i for k, g in enumerate(good) if not g and len(strings[k]) > 1 for i in strings[k]]
        if again:
            out.put(np.array(again), self.align([texts[i] for i in again], joined=False))
        return out

    def _cut(self, a: np.ndarray, b: np.ndarray, size: np.ndarray) -> Aligned:
        """Alignments of texts of ``size`` bytes that stand one after the other, from all their ids."""
        a_end, b_end = np.cumsum(self.a_bytes[2][a]), np.cumsum(self.b_bytes[2][b])
        bound = np.concatenate([[0], np.cumsum(size)])
        ends_a, ends_b = np.zeros(bound[-1] + 1, dtype=bool), np.zeros(bound[-1] + 1, dtype=bool)
        ends_a[a_end] = ends_b[b_end] = True
        last_a, last_b = ends_b[a_end], ends_a[b_end]
        common = a_end[last_a]
        # Items in writing order: the A ids of a group, then its B ids, each with the sign that follows it.
        group_a, group_b = np.cumsum(last_a) - last_a, np.cumsum(last_b) - last_b
        many_a, many_b = np.bincount(group_a), np.bincount(group_b)
        place_a = np.arange(len(a)) + (np.cumsum(many_b) - many_b)[group_a]
        place_b = np.arange(len(b)) + np.cumsum(many_a)[group_b]
        item, sign = np.empty(len(a) + len(b), dtype=np.int64), np.empty(len(a) + len(b), dtype=np.uint8)
        item[place_a], item[place_b] = a, b
        sign[place_a], sign[place_b] = np.where(last_a, ord("|"), ord(",")), np.where(last_b, ord(";"), ord(","))
        digits, first, width = self.digits
        end = np.cumsum(width[item] + 1)
        body = np.empty(end[-1], dtype=np.uint8)
        body[expand(end - 1 - width[item], width[item])] = digits[expand(first[item], width[item])]
        body[end - 1] = sign
        upto_a, upto_b, upto = (np.searchsorted(x, bound, side="right") for x in (a_end, b_end, common))
        written = np.concatenate([[0], end])[upto_a + upto_b].tolist()
        text = body.tobytes()
        groups = np.empty(len(size), dtype=object)
        groups[:] = [text[x:y] for x, y in zip(written, written[1:], strict=False)]
        closed = ends_a[bound[1:]] & ends_b[bound[1:]]
        return Aligned(closed & np.concatenate([[True], closed[:-1]]), np.diff(upto_a), np.diff(upto_b), np.diff(upto), upto[:-1],
                       a[last_a] * PAIR + b[last_b], groups)


def _spell(ids: np.ndarray, table: tuple[np.ndarray, np.ndarray, np.ndarray]) -> bytes:
    data, first, size = table
    return data[expand(first[ids], size[ids])].tobytes()


@functools.lru_cache(maxsize=1)
def _pair(a_path: str, b_path: str) -> Pair:
    return Pair(a_path, b_path)


def _spaced(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of all texts, a space before each that is not empty, and the row offsets."""
    data, bounds = raw(texts)
    size = np.diff(bounds)
    filled = size > 0
    return np.insert(data, bounds[:-1][filled], 32), np.concatenate([[0], np.cumsum(size + filled)])


def _white_before(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Whether the character that ends before each byte position is white space of Unicode (or a control separator)."""
    one, two, three = data[at - 1], data[np.maximum(at - 2, 0)], data[np.maximum(at - 3, 0)]
    white = (one <= 32) & ((one == 32) | (one >= 9) & (one <= 13) | (one >= 28))
    white |= (two == 0xC2) & ((one == 0x85) | (one == 0xA0))
    general = (two == 0x80) & ((one <= 0x8A) & (one >= 0x80) | (one == 0xA8) | (one == 0xA9) | (one == 0xAF)) | (two == 0x81) & (one == 0x9F)
    return white | (three == 0xE2) & general | (three == 0xE1) & (two == 0x9A) & (one == 0x80) | (three == 0xE3) & (two == 0x80) & (one == 0x80)


def chunk_starts(data: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Where texts can be cut so that both tokenizers give the tokens of the whole.

    Cuts are before a space that follows a character other than white space: A's
    pattern never reaches from such a character over the space, and none of B's
    pieces holds a space after another character. A text's last byte starts no
    chunk, since B adds a space of its own only to what is not empty.
    """
    space = np.flatnonzero(data == 32)
    space = space[space > 0]
    last = np.zeros(len(data) + 1, dtype=bool)
    last[bounds[1:]] = True
    space = space[~last[space + 1] & ~_white_before(data, space)]
    return np.union1d(bounds[:-1][np.diff(bounds) > 0], space)


class _Container:
    """Rows of one container and the pair occurrences of their parts, OR-merged when it is closed."""

    def __init__(self, number: int):
        self.number = number
        self.ids: list[pa.Array] = []
        self.rows: list[tuple[np.ndarray, ...]] = []
        self.hashes: list[str] = []
        self.codes: list[np.ndarray] = []
        self.places: list[np.ndarray] = []
        self.times: list[np.ndarray] = []
        self.n = self.bytes = 0

    def add(self, ids: pa.Array, texts: pa.Array, pair: Pair) -> None:
        data, bounds = _spaced(texts)
        n = len(ids)
        starts = chunk_starts(data, bounds)
        offsets = pa.py_buffer(np.append(starts, len(data)).astype(np.int64))
        chunks = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(starts), [None, offsets, pa.py_buffer(data)]).dictionary_encode()
        found = pair.align(chunks.dictionary.to_pylist())
        code = chunks.indices.to_numpy()
        row = np.searchsorted(bounds, starts, side="right") - 1
        # A text with a chunk whose bytes differ is judged, and if it passes aligned, as a whole.
        again = np.unique(row[~found.ok[code]])
        if len(again):
            whole = pair.align([bytes(data[bounds[k]:bounds[k + 1]]) for k in again], joined=False)
            both = Aligned.empty(len(found.ok) + len(again))
            both.put(np.arange(len(found.ok)), found)
            both.put(np.arange(len(found.ok), len(both.ok)), whole)
            keep = ~np.isin(row, again)
            code = np.concatenate([code[keep], len(found.ok) + np.flatnonzero(whole.ok)])
            row = np.concatenate([row[keep], again[whole.ok]])
            order = np.argsort(row, kind="stable")
            code, row, found = code[order], row[order], both
        self.rows.append(tuple(np.bincount(row, weights=x[code], minlength=n).astype(np.int64) for x in (found.n_a, found.n_b, found.n_links)))
        text = found.groups[code].tolist()
        ends = np.concatenate([[0], np.cumsum(np.bincount(row, minlength=n))]).tolist()
        self.hashes += [hashlib.sha256(memoryview(b"".join(text[a:b]))[:-1]).hexdigest() if b > a else "" for a, b in zip(ends, ends[1:], strict=False)]
        name, named = np.unique(found.codes, return_inverse=True)
        which = named[expand(found.first_link[code], found.n_links[code])] if len(code) else code.astype(np.int64)
        key, times = np.unique(which * n + np.repeat(row, found.n_links[code]), return_counts=True)
        self.codes.append(name[key // n])
        self.places.append((key % n + self.n).astype(np.uint16))
        self.times.append(times)
        self.ids.append(ids)
        self.n += n
        self.bytes += len(data)

    def batches(self) -> Iterator[pa.RecordBatch]:
        """Rows of documents, then rows of planes."""
        n_a, n_b, groups = (np.concatenate(x) for x in zip(*self.rows, strict=True))
        number = pa.array(np.full(self.n, self.number))
        yield _batch(self.n, container=number, place=pa.array(np.arange(self.n, dtype=np.int32)), doc_id=pa.concat_arrays(self.ids),
                     n_a=pa.array(n_a), n_b=pa.array(n_b), n_groups=pa.array(groups), groups_sha256=pa.array(self.hashes))
        code, place, times = (np.concatenate(x) for x in (self.codes, self.places, self.times))
        for plane in range(1 + int(times.max(initial=1) - 1).bit_length()):
            inside = slice(None) if plane == 0 else ((times - 1) >> (plane - 1)) & 1 == 1
            # Parts hold different rows, so a stable sort by pair leaves the places of a pair in order: their union.
            order = np.argsort(code[inside], kind="stable")
            names, first, size = np.unique(code[inside][order], return_index=True, return_counts=True)
            for at in range(0, len(names), 20_000):
                to = min(at + 20_000, len(names))
                lo, hi = first[at], first[to - 1] + size[to - 1]
                yield _batch(to - at, container=pa.array(np.full(to - at, self.number)), a=pa.array((names[at:to] // PAIR).astype(np.int32)),
                             b=pa.array((names[at:to] % PAIR).astype(np.int32)), plane=pa.array(np.full(to - at, plane, dtype=np.int32)),
                             members=pa.array(size[at:to]), bitmap=packed_bitmaps(place[inside][order][lo:hi], size[at:to]))


def packed_bitmaps(places: np.ndarray, sizes: np.ndarray) -> pa.Array:
    """A compressed bitmap for each run of increasing places: two bytes a member, or a bit a place where that is less."""
    ends = np.cumsum(sizes)
    first = ends - sizes
    bits = places[ends - 1].astype(np.int64) // 8 + 1
    dense = bits < 2 * sizes
    width = 1 + np.where(dense, bits, 2 * sizes)
    offsets = np.concatenate([[0], np.cumsum(width)])
    out = np.zeros(offsets[-1], dtype=np.uint8)
    out[offsets[:-1]] = np.where(dense, BITS, PLACES)
    sparse = np.flatnonzero(~dense)
    source = expand(first[sparse], sizes[sparse])
    target = expand(np.zeros(len(sparse), dtype=np.int64), 2 * sizes[sparse]) + np.repeat(offsets[sparse] + 1, 2 * sizes[sparse])
    out[target] = places[source].astype("<u2").view(np.uint8)
    dense = np.flatnonzero(dense)
    member = places[expand(first[dense], sizes[dense])].astype(np.int64)
    np.bitwise_or.at(out, np.repeat(offsets[dense] + 1, sizes[dense]) + member // 8, (1 << member % 8).astype(np.uint8))
    return pa.Array.from_buffers(pa.binary(), len(sizes), [None, pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(out)])


def members_of(bitmaps: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(places of all bitmaps one after the other, how many each has)."""
    data, bounds = raw_binary(bitmaps)
    n = len(bitmaps)
    kind = data[bounds[:-1]] if n else np.zeros(0, dtype=np.uint8)
    body = np.diff(bounds) - 1
    sparse, dense = np.flatnonzero(kind == PLACES), np.flatnonzero(kind == BITS)
    source = expand(bounds[sparse] + 1, body[sparse])
    places = np.ascontiguousarray(data[source]).view("<u2").astype(np.int64)
    owner = np.repeat(sparse, body[sparse] // 2)
    bits = np.unpackbits(data[expand(bounds[dense] + 1, body[dense])], bitorder="little")
    at = np.flatnonzero(bits)
    start = np.cumsum(8 * body[dense]) - 8 * body[dense]
    which = np.searchsorted(start, at, side="right") - 1
    owner = np.concatenate([owner, dense[which]])
    places = np.concatenate([places, at - start[which]]) if len(dense) else places
    order = np.argsort(owner, kind="stable")
    return places[order], np.bincount(owner, minlength=n)


def raw_binary(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    column = column.cast(pa.large_binary())
    _, offsets, data = column.buffers()
    bounds = np.frombuffer(offsets, dtype=np.int64)[column.offset:column.offset + len(column) + 1]
    body = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, dtype=np.uint8)
    return body[bounds[0]:bounds[-1]], bounds - bounds[0]


_KINDS = {"container": pa.int64(), "place": pa.int32(), "n_a": pa.int64(), "n_b": pa.int64(), "n_groups": pa.int64(), "groups_sha256": pa.string(),
          "a": pa.int32(), "b": pa.int32(), "plane": pa.int32(), "members": pa.int64(), "bitmap": pa.binary()}


def _batch(n: int, doc_id: pa.Array | None = None, **columns: pa.Array) -> pa.RecordBatch:
    arrays = [columns.get(name, pa.nulls(n, kind)) for name, kind in _KINDS.items()]
    return pa.RecordBatch.from_arrays([*arrays, doc_id if doc_id is not None else pa.nulls(n)], [*_KINDS, "doc_id"])


def _containers(a_path: str, b_path: str, id_kind: pa.DataType, container_bytes: int, container_rows: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from countygeo.llm.text import blocks

        def closed(c: _Container) -> Iterator[pa.RecordBatch]:
            for out in c.batches():
                ids = out.column("doc_id")
                yield out if ids.type == id_kind else out.set_column(out.num_columns - 1, "doc_id", pa.nulls(out.num_rows, id_kind))

        pair = _pair(a_path, b_path)
        number = TaskContext.get().partitionId() << 32
        open_ = _Container(number)
        for part in blocks(batches, limit=PART_BYTES):
            for at in range(0, part.num_rows, container_rows):
                rows = part.slice(at, container_rows)
                if open_.n and (open_.n + rows.num_rows > container_rows or open_.bytes + rows.nbytes > container_bytes):
                    yield from closed(open_)
                    number += 1
                    open_ = _Container(number)
                open_.add(rows.column("doc_id"), rows.column("text"), pair)
        if open_.n:
            yield from closed(open_)

    return run


def inverted_pairs(documents: DataFrame, doc_id: str = "doc_id", text: str = "text", a_path: str | None = None, b_path: str | None = None,
                   container_bytes: int = CONTAINER_BYTES, container_rows: int = CONTAINER_ROWS) -> tuple[DataFrame, DataFrame]:
    """(rows of documents, rows of planes), both stored.

    Documents are numbered inside containers, runs of rows of one task. For each
    pair of ids that ends tokens together the postings of a container are
    bitmaps over these places: plane 0 has the documents with the pair, plane k
    those whose further links of the pair (links less one) have bit k - 1 set.
    Bitmaps of the parts of a container are merged by OR as it is closed.
    """
    own_a, own_b = vocabulary_paths() if a_path is None or b_path is None else (None, None)
    docs = documents.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    kind = docs.schema["doc_id"].dataType
    from pyspark.sql.pandas.types import to_arrow_type

    stored = checkpoint(docs.mapInArrow(
        _containers(a_path or own_a, b_path or own_b, to_arrow_type(kind), container_bytes, container_rows),
        "container long, place int, n_a long, n_b long, n_groups long, groups_sha256 string, a int, b int, plane int, members long, "
        f"bitmap binary, doc_id {kind.simpleString()}"))
    return (stored.where("place IS NOT NULL").select(F.col("container").alias("container"), "place", "doc_id", "n_a", "n_b", "n_groups", "groups_sha256"),
            stored.where("place IS NULL").select("container", "a", "b", "plane", "members", "bitmap"))


def pair_counts(planes: DataFrame) -> DataFrame:
    """a, b, n_docs, n_links over the corpus from the sizes of the bitmaps, and whether n_links is the highest of its b.

    One row a pair of ids, so its size is bounded by the vocabularies; tasks add
    up their containers before the shuffle.
    """
    times = F.col("members") * F.expr("shiftleft(1L, greatest(plane - 1, 0))")
    counts = checkpoint(planes.groupBy("a", "b").agg(F.sum(F.when(F.col("plane") == 0, F.col("members"))).alias("n_docs"),
                                                     F.sum(times).alias("n_links")))
    highest = counts.groupBy("b").agg(F.max("n_links").alias("highest"))
    return (counts.join(broadcast_if_small(highest), "b")
            .select("a", "b", "n_docs", "n_links", (F.col("n_links") == F.col("highest")).alias("best")))


def _scores(documents: pa.Table, planes: pa.Table) -> pa.Table:
    """Adds n_best and count_sum to the documents of one container, from its planes with their pairs' counts."""
    n = documents.num_rows
    best, total = np.zeros(n, dtype=np.int64), np.zeros(n, dtype=np.int64)
    planes = planes.combine_chunks()
    for batch in planes.to_batches(max_chunksize=20_000):
        places, size = members_of(batch.column("bitmap"))
        plane = batch.column("plane").to_numpy()
        times = np.int64(1) << np.maximum(plane - 1, 0).astype(np.int64)
        np.add.at(total, places, np.repeat(times * batch.column("n_links").to_numpy(), size))
        np.add.at(best, places, np.repeat(times * batch.column("best").to_numpy(zero_copy_only=False), size))
    place = documents.column("place").to_numpy()
    return (documents.select(["doc_id", "n_a", "n_b", "n_groups", "groups_sha256"])
            .append_column("n_best", pa.array(best[place])).append_column("count_sum", pa.array(total[place])))


def align_tokenizers(documents: DataFrame, doc_id: str = "doc_id", text: str = "text", a_path: str | None = None, b_path: str | None = None,
                     container_bytes: int = CONTAINER_BYTES, container_rows: int = CONTAINER_ROWS) -> DataFrame:
    """Per row: tokens of A and B, groups between common ends, and how the links' pairs stand in the corpus.

    Tokens end together at most once a byte, so there is a link for each group.
    ``n_best`` counts the links whose pair has the most links of its B id,
    ``count_sum`` adds up the links that all pairs have in the corpus. Counts
    return to the documents through the postings, container by container, which
    bounds what a task holds; a pair that is in all documents is a row for each
    container.

    Null and empty texts, and those whose tokens' bytes differ from the text, have
    no tokens and zeros, and an empty hash. Repeated rows count each for itself;
    equal counts are all highest. A long text is a container of its own. Other
    columns are ignored; an empty table gives no rows.
    """
    rows, planes = inverted_pairs(documents, doc_id, text, a_path, b_path, container_bytes, container_rows)
    scored = planes.join(broadcast_if_small(pair_counts(planes)), ["a", "b"]).select("container", "plane", "bitmap", "n_links", "best")
    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.groupBy("container").cogroup(scored.groupBy("container")).applyInArrow(
        _scores, f"doc_id {kind}, n_a long, n_b long, n_groups long, groups_sha256 string, n_best long, count_sum long")
