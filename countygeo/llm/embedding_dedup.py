"""Near duplicates of embeddings by int8 tile products with error bounds (operator 3)."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from countygeo.llm.graph import components, local_roots
from countygeo.runtime import checkpoint

# Rows of a tile; a task multiplies two tiles.
TILE = 1024
# Slack for rounding in double precision.
EPS = 1e-9


def quantise(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(codes, scale, error) of unit rows: ``x = scale * codes + e`` with ``|e| <= error``."""
    scale = np.abs(x).max(axis=1) / 127.0
    codes = np.rint(x / scale[:, None])
    error = np.linalg.norm(x - codes * scale[:, None], axis=1) + EPS
    return codes.astype(np.int8), scale, error


def unit(rows: np.ndarray) -> np.ndarray:
    """Rows in double precision at length one, without overflow."""
    x = rows / np.abs(rows).max(axis=1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def linked(x: np.ndarray, y: np.ndarray, threshold: float) -> np.ndarray:
    """Which pairs of unit rows have cosine >= ``threshold``, exactly.

    With x = sq + e the product differs from the scaled product of codes by at
    most (1 + |e_x|)|e_y| + |e_x|. Codes are multiplied exactly: a sum of 1,040
    products below 2**14 fits a float's 24 bits, longer rows use doubles. Pairs
    within the bound of the threshold, and only these, are multiplied again in
    double precision.
    """
    (p, sp, ep), (q, sq, eq) = quantise(x), quantise(y)
    kind = np.float32 if x.shape[1] <= 1040 else np.float64
    near = (p.astype(kind) @ q.astype(kind).T).astype(np.float64) * sp[:, None] * sq[None, :]
    bound = (1 + ep[:, None]) * eq[None, :] + ep[:, None]
    out = near - bound >= threshold
    i, j = np.nonzero((near + bound >= threshold) & ~out)
    for at in range(0, len(i), 65_536):
        a, b = i[at:at + 65_536], j[at:at + 65_536]
        out[a, b] = np.einsum("ij,ij->i", x[a], y[b]) >= threshold
    return out


def _tile_pair(threshold: float):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("rep", ignore_index=True)
        x = unit(np.array(pdf["embedding"].tolist(), dtype=np.float64))
        lo, hi = int(pdf["lo"].iloc[0]), int(pdf["hi"].iloc[0])
        tile = pdf["tile"].to_numpy()
        weight = pdf["members"].to_numpy()
        n = len(pdf)
        links = np.zeros((n, n), dtype=bool)
        first, second = np.flatnonzero(tile == lo), np.flatnonzero(tile == hi)
        if len(first) and len(second):
            found = linked(x[first], x[second], threshold)
            links[np.ix_(first, second)] = found
            links[np.ix_(second, first)] |= found.T
        np.fill_diagonal(links, False)
        rep = pdf["rep"].to_numpy()
        count = links @ weight
        keep = count > 0
        return pd.DataFrame({"rep": rep[keep], "links": count[keep], "root": rep[local_roots(links)][keep]})

    return run


def near_vectors(vectors: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding", label: str = "label",
                 threshold: float = 0.98, tile: int = TILE) -> DataFrame:
    """One row per distinct (id, embedding, label) with its links, component and whether it stays.

    Vectors link if their labels are equal, their sizes too, and their cosine is
    at least ``threshold``. Equal vectors of a label become one weighted row
    first. The rest is cut by hash into tiles of about ``tile`` rows, and each
    pair of tiles of a label is one task's work: at most two tiles of memory,
    whatever the label's size, and never a row per pair. Tasks return link
    counts and one edge per row to its least local relative.

    Null labels, null, empty or zero vectors and those with null or non-finite
    parts have no links and are their own component. Rows with a null id link
    with nothing, have a null component and are kept. Repeated rows are one
    row. Columns of other names are ignored. An empty table gives no rows.
    """
    rows = vectors.select(F.col(vec_id).alias("vec_id"), F.col(embedding).alias("embedding"),
                          F.col(label).alias("label")).dropDuplicates()
    value = F.col("embedding")
    finite = F.forall(value, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < F.lit(float("inf"))))
    usable = rows.where(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & (F.size(value) > 0) & finite
                        & F.exists(value, lambda v: v != 0))
    groups = checkpoint(usable.groupBy("label", "embedding").agg(F.min("vec_id").alias("rep"), F.count("*").alias("members"))
                        .withColumn("dim", F.size("embedding")))
    tiles = groups.groupBy("label", "dim").agg(F.ceil(F.count("*") / tile).cast("int").alias("tiles"))
    placed = groups.join(tiles, ["label", "dim"]).withColumn("tile", F.pmod(F.xxhash64("rep"), F.col("tiles")).cast("int"))
    other = F.explode(F.sequence(F.lit(0), F.col("tiles") - 1))
    pairs = placed.withColumn("other", other).select(
        "label", "dim", "rep", "embedding", "members", "tile",
        F.least("tile", "other").alias("lo"), F.greatest("tile", "other").alias("hi"))
    found = checkpoint(pairs.groupBy("label", "dim", "lo", "hi")
                       .applyInPandas(_tile_pair(threshold), "rep long, links long, root long"))
    reached = components(found.select(F.col("rep").alias("a"), F.col("root").alias("b")))
    direct = found.groupBy("rep").agg(F.sum("links").alias("links"))
    by_group = (groups.where("members > 1").select("rep", "members")
                .join(direct, "rep", "full").join(reached.withColumnRenamed("node", "rep"), "rep", "left")
                .select("rep", (F.coalesce("members", F.lit(1)) - 1 + F.coalesce("links", F.lit(0))).alias("n_links"),
                        F.coalesce("component", "rep").alias("component_id")))
    mine = groups.select("label", "embedding", "rep")
    return (rows.join(mine, ["label", "embedding"], "left")
            .withColumn("rep", F.when(F.col("vec_id").isNotNull(), F.col("rep")))
            .join(by_group, "rep", "left")
            .select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
                    F.coalesce("component_id", "vec_id").alias("component_id"))
            .withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True))))
