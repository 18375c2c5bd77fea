"""Exact n-gram Jaccard self-join by universe partition (operator 8)."""

from __future__ import annotations

import functools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from countygeo.llm.graph import components, local_roots
from countygeo.llm.text import VISIBLE, blocks, long_list, mix, raw, words
from countygeo.runtime import broadcast_if_small, checkpoint

# Words of a shingle; links need PERCENT * union <= 100 * intersection.
SHINGLE, PERCENT = 3, 90
# Classes of a verification tile; a task compares two tiles.
TILE = 256
# Columns of the incidence matrix that is multiplied at once.
COLUMNS = 4096
# Signature rows brought together in a task before the shuffle.
CHUNK = 1_000_000
# Empty segments whose signatures a document leaves out at most.
SPARE = 1
# Cost model: chance that an unrelated document shares a shingle, and cost of a candidate in signatures.
CHANCE, CANDIDATE = 0.02, 3.0


def shingle_sets(batch: pa.RecordBatch, size: int) -> list[np.ndarray]:
    """Sorted distinct 64-bit shingle hashes of each text."""
    data, bounds = raw(batch.column("text"))
    hashed, _, _, row = words(data, bounds, VISIBLE)
    count = np.bincount(row, minlength=batch.num_rows)
    end = np.cumsum(count)
    joined = np.zeros(max(0, len(hashed) - size + 1), dtype=np.uint64)
    for k in range(size):
        joined = mix(joined * np.uint64(3) + hashed[k:len(hashed) - size + 1 + k])
    out = []
    for n, to in zip(count, end, strict=True):
        if n >= size:
            out.append(np.unique(joined[to - n:to - size + 1]))
        else:
            short = np.full(1, n, dtype=np.uint64)
            for h in hashed[to - n:to]:
                short = mix(short + h)
            out.append(short[:min(n, 1)])
    return out


def band_of(n: np.ndarray | int, percent: int = PERCENT) -> int:
    return int(np.searchsorted(band_starts(percent), n, side="right")) - 1


@functools.lru_cache
def band_starts(percent: int) -> np.ndarray:
    """Least size of each band; sets that link are in the same band or the next."""
    starts = [1]
    while starts[-1] < 1 << 40:
        starts.append(starts[-1] * 100 // percent + 1)
    return np.array(starts, dtype=np.int64)


def distance(size: int, percent: int = PERCENT) -> int:
    """Greatest symmetric difference of two linked sets of at most ``size`` shingles."""
    return (2 * size * (100 - percent)) // (100 + percent)


def allocation(band: int, population: int, percent: int = PERCENT) -> tuple[int, int]:
    """(segments, of them with one-deletion neighbourhoods) of a band, at the least cost.

    Linked sets differ in at most H shingles. A difference spoils one of a
    segments compared whole, two spoil one of b segments compared up to one
    deletion. Without the latter, a >= H + 1 + SPARE leaves SPARE + 1 that agree.
    With them, a + 2b >= H + 1 + 2 * SPARE does, and covers a segment that is
    empty in one set only, which uses up one difference. A whole segment costs one
    signature, a neighbourhood one more for each shingle; fewer segments are longer
    and meet fewer unrelated sets, of which the band holds ``population``.
    """
    starts = band_starts(percent)
    low, high = int(starts[band]), int(starts[band + 1]) - 1
    most = distance(high, percent)
    if most == 0:
        return 0, 0
    need = most + 1 + 2 * SPARE
    best = None
    for near in {0, 1, need // 4, need // 2}:
        whole = need - 2 * near if near else most + 1 + SPARE
        if whole < 0 or near + whole < 1:
            continue
        total = near + whole
        length = low / total
        signatures = total + near * length
        meets = total * population * CHANCE ** length * (1 + near / total * length)
        cost = signatures + CANDIDATE * meets
        if best is None or cost < best[0]:
            best = (cost, total, near)
    return best[1], best[2]


def signatures(shingles: np.ndarray, plan: dict[int, tuple[int, int]], percent: int = PERCENT) -> np.ndarray:
    """Signatures of a set in its own band and the next; sets that link share one.

    A shingle's segment follows from its high bits, so segments are ranges of
    the sorted set. A set with more than SPARE empty segments also has the
    signatures of these.
    """
    own = band_of(len(shingles), percent)
    value = mix(shingles ^ np.uint64(0x5851F42D4C957F2D))
    total = np.concatenate([np.zeros(1, dtype=np.uint64), np.cumsum(value, dtype=np.uint64)])
    out = []
    for band in (own, own + 1):
        count, near = plan.get(band, (0, 0))
        if not count:
            continue
        segment = ((shingles >> np.uint64(32)) * np.uint64(count)) >> np.uint64(32)
        cut = np.searchsorted(segment, np.arange(count + 1, dtype=np.uint64))
        sums = total[cut[1:]] - total[cut[:-1]]
        seed = mix(np.arange(count, dtype=np.uint64) + np.uint64(band << 24 | 1))
        full = cut[1:] > cut[:-1]
        if count - full.sum() > SPARE:
            full[:] = True
        out.append(mix(sums + seed)[full])
        deletable = np.flatnonzero(segment < near)
        which = segment[deletable].astype(np.int64)
        out.append(mix(sums[which] - value[deletable] + seed[which]))
    return np.unique(np.concatenate(out)) if out else shingles[:0]


def _facts(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in blocks(batches):
            sets = shingle_sets(batch, size)
            first = np.array([mix(s).sum(dtype=np.uint64) for s in sets], dtype=np.uint64)
            second = np.array([np.bitwise_xor.reduce(mix(s + np.uint64(7))) if len(s) else 0 for s in sets], dtype=np.uint64)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array([len(s) for s in sets], pa.int64()), pa.array(first.view(np.int64)),
                 pa.array(second.view(np.int64))], ["doc_id", "n_shingles", "d1", "d2"])

    return run


def _signed(size: int, plan: dict[int, tuple[int, int]], percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in blocks(batches):
            found = [signatures(s, plan, percent) if len(s) else s for s in shingle_sets(batch, size)]
            sizes = np.array([len(f) for f in found], dtype=np.int64)
            flat = np.concatenate(found).view(np.int64) if found else np.zeros(0, dtype=np.int64)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), long_list(flat, sizes)], ["doc_id", "signatures"])

    return run


def _stars(sig: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sorted rows; whether each begins a group of equal signatures, and where its group begins."""
    new = np.ones(len(sig), dtype=bool)
    new[1:] = sig[1:] != sig[:-1]
    return new, np.flatnonzero(new), np.cumsum(new) - 1


def _edges(sig: np.ndarray | None, a: np.ndarray, b: np.ndarray | None) -> pa.RecordBatch:
    n = len(a)
    return pa.RecordBatch.from_arrays(
        [pa.nulls(n, pa.int64()) if sig is None else pa.array(sig), pa.array(a), pa.nulls(n, pa.int64()) if b is None else pa.array(b)],
        ["sig", "a", "b"])


def _collapse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Within a chunk of documents: edges to the first document of each signature, which alone goes on."""
    held: list[tuple[np.ndarray, np.ndarray]] = []
    rows = 0

    def flush() -> Iterator[pa.RecordBatch]:
        sig, doc = (np.concatenate(x) for x in zip(*held, strict=True))
        order = np.lexsort((doc, sig))
        sig, doc = sig[order], doc[order]
        new, first, group = _stars(sig, doc)
        pair = np.unique(np.stack([doc[first][group][~new], doc[~new]]), axis=1)
        yield _edges(None, pair[0], pair[1])
        yield _edges(sig[first], doc[first], None)

    for batch in batches:
        lists = batch.column("signatures")
        sizes = np.diff(lists.offsets.to_numpy())
        held.append((lists.flatten().to_numpy(), np.repeat(batch.column("doc_id").to_numpy(), sizes)))
        rows += len(held[-1][0])
        if rows >= CHUNK:
            yield from flush()
            held, rows = [], 0
    if rows:
        yield from flush()


def _meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Edges between documents of equal signatures; rows come sorted by signature and document."""
    last_sig = last_doc = None
    for batch in batches:
        sig, doc = batch.column("sig").to_numpy(), batch.column("a").to_numpy()
        if not len(sig):
            continue
        new, first, group = _stars(sig, doc)
        head = doc[first].copy()
        if last_sig is not None and sig[0] == last_sig:
            head[0] = last_doc
            new[0] = False
        last_sig, last_doc = sig[-1], head[-1]
        pair = np.unique(np.stack([head[group][~new], doc[~new]]), axis=1)
        yield pa.RecordBatch.from_arrays([pa.array(pair[0]), pa.array(pair[1])], ["a", "b"])


def _sets(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in blocks(batches):
            sets = shingle_sets(batch, size)
            flat = np.concatenate(sets).view(np.int64)
            keep = [c for c in batch.schema.names if c != "text"]
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in keep], long_list(flat, np.array([len(s) for s in sets]))],
                                             [*keep, "shingles"])

    return run


def intersections(flat: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Pairwise intersection sizes of sets given one after the other.

    Shingles of one set only are left out; the others become columns of 0/1
    matrices of bounded width whose products are added up.
    """
    n = len(sizes)
    _, column, count = np.unique(flat, return_inverse=True, return_counts=True)
    owner = np.repeat(np.arange(n), sizes)
    keep = count[column] > 1
    number = np.cumsum(count > 1) - 1
    column, owner = number[column[keep]], owner[keep]
    order = np.argsort(column, kind="stable")
    column, owner = column[order], owner[order]
    out = np.zeros((n, n), dtype=np.int64)
    width = int(column[-1]) + 1 if len(column) else 0
    for at in range(0, width, COLUMNS):
        lo, hi = np.searchsorted(column, [at, at + COLUMNS])
        part = np.zeros((n, min(COLUMNS, width - at)), dtype=np.float32)
        part[owner[lo:hi], column[lo:hi] - at] = 1
        out += (part @ part.T).astype(np.int64)
    return out


def _verify(percent: int):
    def run(table: pa.Table) -> pa.Table:
        table = table.combine_chunks().sort_by("doc_id")
        doc, members, tile = (table.column(c).to_numpy() for c in ("doc_id", "members", "tile"))
        lo, hi = table.column("lo")[0].as_py(), table.column("hi")[0].as_py()
        lists = table.column("shingles").chunk(0)
        sizes = np.diff(lists.offsets.to_numpy())
        both = intersections(lists.flatten().to_numpy(), sizes)
        links = 100 * both >= percent * (sizes[:, None] + sizes[None, :] - both)
        across = (tile[:, None] == lo) & (tile[None, :] == hi)
        links &= across | across.T
        np.fill_diagonal(links, False)
        count = links @ members
        keep = count > 0
        return pa.table({"doc_id": doc[keep], "links": count[keep], "root": doc[local_roots(links)][keep]})

    return run


def jaccard_groups(documents: DataFrame, doc_id: str = "doc_id", text: str = "text", size: int = SHINGLE,
                   percent: int = PERCENT, tile: int = TILE) -> DataFrame:
    """n_shingles, component_id and n_links of each document.

    A document's set holds its distinct ``size``-word shingles, as 64-bit
    hashes; with fewer words the whole sequence is its one shingle. Documents
    link if 100 * intersection >= ``percent`` * union. n_links counts the other
    documents linked directly, component_id is the least id reachable.

    1. Equal sets become one class (a map-side ``min`` and count).
    2. The universe is cut into segments, as many as the size band allows
       differences plus one; classes that link share a segment whole or up to one
       deletion. Signatures meet first inside tasks, then by a shuffle in which a
       signature has one row per chunk. Of a signature's classes each has one edge
       to the first, so the work is linear however many share it.
    3. Components of these edges hold all links. Inside a component tiles of
       ``tile`` classes are multiplied as 0/1 matrices, which gives intersections
       exactly; a task holds two tiles and no pair is ever a row.
    4. Components of the verified links.

    Null and empty texts, and those of white space, have an empty set, no links
    and are their own component; so are rows with a null id, whose component is
    null. Repeated rows of an id and text are one row. Columns of other names
    are ignored; an empty table gives no rows.
    """
    docs = documents.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    kind = "doc_id long, n_shingles long, d1 long, d2 long"
    facts = checkpoint(docs.mapInArrow(_facts(size), kind))
    digest = ["n_shingles", "d1", "d2"]
    distinct = facts.where("doc_id IS NOT NULL AND n_shingles > 0").dropDuplicates(["doc_id", *digest])
    classes = checkpoint(distinct.groupBy(*digest).agg(F.min("doc_id").alias("rep"), F.count("*").alias("members")))

    scale = F.floor(F.log("n_shingles") / math.log(100 / percent))
    rough = classes.groupBy(scale.alias("scale")).agg(F.count("*").alias("n"), F.max("n_shingles").alias("most")).collect()
    population = [0] * (band_of(max((r["most"] for r in rough), default=1), percent) + 2)
    for r in rough:  # a row per power of 100 / percent up to the largest set
        own = band_of(r["most"], percent)
        population[own] += r["n"]
        population[own + 1] += r["n"]
    plan = {b: allocation(b, n, percent) for b, n in enumerate(population)}

    least = next((int(band_starts(percent)[b]) for b, (count, _) in plan.items() if count), 1 << 40)
    # A set joins the next band too, so the band below the first with differences is signed as well.
    able = classes.where(F.col("n_shingles") >= least * percent // 100).select(F.col("rep").alias("doc_id"), "n_shingles", "d1", "d2")
    signed = docs.where("doc_id IS NOT NULL").mapInArrow(_signed(size, plan, percent), "doc_id long, signatures array<bigint>")
    met = checkpoint(signed.where(F.size("signatures") > 0).join(able.select("doc_id").distinct(), "doc_id")
                     .mapInArrow(_collapse, "sig long, a long, b long"))
    sorted_ = met.where("b IS NULL").select("sig", "a").repartition("sig").sortWithinPartitions("sig", "a")
    near = components(met.where("b IS NOT NULL").select("a", "b").unionAll(sorted_.mapInArrow(_meet, "a long, b long")))

    sizes = near.groupBy("component").agg(F.ceil(F.count("*") / tile).cast("int").alias("tiles"))
    placed = (near.withColumnRenamed("node", "doc_id").join(sizes, "component")
              .withColumn("tile", F.pmod(F.xxhash64("doc_id"), F.col("tiles")).cast("int")))
    chosen = broadcast_if_small(placed)
    by_class = classes.select(F.col("rep").alias("doc_id"), "members")
    sets = (docs.join(chosen, "doc_id").mapInArrow(_sets(size), "doc_id long, component long, tiles int, tile int, shingles array<bigint>")
            .join(by_class, "doc_id").dropDuplicates(["doc_id", "component"]))
    other = F.explode(F.sequence(F.lit(0), F.col("tiles") - 1))
    pairs = sets.withColumn("other", other).select(
        "component", "doc_id", "members", "shingles", "tile", F.least("tile", "other").alias("lo"),
        F.greatest("tile", "other").alias("hi"))
    found = checkpoint(pairs.groupBy("component", "lo", "hi").applyInArrow(_verify(percent), "doc_id long, links long, root long"))

    reached = components(found.select(F.col("doc_id").alias("a"), F.col("root").alias("b")))
    direct = found.groupBy("doc_id").agg(F.sum("links").alias("links"))
    by_rep = direct.join(reached.withColumnRenamed("node", "doc_id"), "doc_id").withColumnRenamed("doc_id", "rep")
    known = classes.join(by_rep, "rep", "left").select(
        *digest, (F.col("members") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"),
        F.coalesce("component", "rep").alias("component_id"))
    rest = facts.where("doc_id IS NULL OR n_shingles = 0").dropDuplicates(["doc_id", *digest])
    return (distinct.join(known, digest).select("doc_id", "n_shingles", "component_id", "n_links")
            .unionAll(rest.select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"), F.lit(0).cast("long").alias("n_links"))))


def first_of_groups(documents: DataFrame, doc_id: str = "doc_id", text: str = "text", size: int = SHINGLE,
                    percent: int = PERCENT) -> DataFrame:
    """Documents without those whose group has a smaller id; columns stay.

    Rows of a null id stay, and so do all rows of an id that stays.
    """
    drop = (jaccard_groups(documents, doc_id, text, size, percent).where("component_id < doc_id")
            .select(F.col("doc_id").alias("__drop")).distinct())
    return documents.join(broadcast_if_small(drop), F.col(doc_id) == F.col("__drop"), "left_anti")
