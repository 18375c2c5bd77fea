"""Point in polygon and nearest neighbour as cell joins."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from countygeo.functions import geo
from countygeo.functions.arrays import bind
from countygeo.runtime import BROADCAST_ROWS, broadcast_if_small, checkpoint

CELL_DEG = 0.1
# Fixed value: slack in degrees for points on a boundary.
BOUNDARY_EPS = 1e-5


def _cell(v: Column, size: float) -> Column:
    return F.floor(v / size)


def polygon_cells(edges: DataFrame, cell_deg: float = CELL_DEG, eps: float = BOUNDARY_EPS) -> DataFrame:
    """Cell index of a boundary edge table: (cx, cy, polys).

    ``edges`` is (adcode, ord, x1, y1, x2, y2), one row per segment; all rings of a
    feature share its ``ord``, holes and parts included. ``polys`` lists, by
    ``ord``, the features whose box meets the cell, each with the edges that cross
    the cell's row. A point needs nothing else: a ray to the east stays in its row.
    """
    low_y, high_y = F.least("y1", "y2") - eps, F.greatest("y1", "y2") + eps
    rows = edges.withColumn("cy", F.explode(F.sequence(_cell(low_y, cell_deg), _cell(high_y, cell_deg))))
    by_row = rows.groupBy("ord", "adcode", "cy").agg(F.collect_list(F.struct("x1", "y1", "x2", "y2")).alias("edges"))
    boxes = edges.groupBy("ord", "adcode").agg(
        (F.min(F.least("x1", "x2")) - eps).alias("west"), (F.max(F.greatest("x1", "x2")) + eps).alias("east"))
    cells = by_row.join(boxes, ["ord", "adcode"]).withColumn(
        "cx", F.explode(F.sequence(_cell(F.col("west"), cell_deg), _cell(F.col("east"), cell_deg))))
    return cells.groupBy("cx", "cy").agg(
        F.sort_array(F.collect_list(F.struct("ord", "adcode", "edges"))).alias("polys"))


def _inside(edges: Column, x: Column, y: Column) -> Column:
    """Odd number of crossings to the east, and not on the boundary."""
    def crosses(e: Column) -> Column:
        straddles = (e["y1"] > y) != (e["y2"] > y)
        at = (e["x2"] - e["x1"]) * (y - e["y1"]) / (e["y2"] - e["y1"]) + e["x1"]
        return straddles & (x < at)

    def touches(e: Column) -> Column:
        cross = (e["x2"] - e["x1"]) * (y - e["y1"]) - (e["y2"] - e["y1"]) * (x - e["x1"])
        return ((cross == 0) & x.between(F.least(e["x1"], e["x2"]), F.greatest(e["x1"], e["x2"]))
                & y.between(F.least(e["y1"], e["y2"]), F.greatest(e["y1"], e["y2"])))

    return (F.size(F.filter(edges, crosses)) % 2 == 1) & ~F.exists(edges, touches)


def _near_edge(edges: Column, x: Column, y: Column, eps: float) -> Column:
    """Some edge passes within ``eps`` degrees."""
    def close(e: Column) -> Column:
        ux, uy = e["x2"] - e["x1"], e["y2"] - e["y1"]
        length = ux * ux + uy * uy
        along = F.when(length > 0, ((x - e["x1"]) * ux + (y - e["y1"]) * uy) / length).otherwise(F.lit(0.0))
        t = F.least(F.greatest(along, F.lit(0.0)), F.lit(1.0))
        gx, gy = e["x1"] + t * ux - x, e["y1"] + t * uy - y
        return gx * gx + gy * gy <= eps * eps

    return F.exists(edges, close)


def locate(points: DataFrame, cells: DataFrame, lng: str = "lng", lat: str = "lat", out: str = "located",
           fallback: bool = False, cell_deg: float = CELL_DEG, eps: float = BOUNDARY_EPS,
           broadcast_rows: int | None = None) -> DataFrame:
    """Add the code of the first feature that contains each point (JN6, JN17).

    With ``fallback`` a point inside no feature takes the first one whose boundary
    is within ``eps`` degrees (JN7). One left join on the cell, then row-local
    arithmetic: no pair table and no grouping of points. A small index is
    broadcast; a larger one is shuffled, with one row per cell, so adaptive
    execution can split the points of a crowded cell.
    """
    # An index row carries edges, so its share of the broadcast budget is smaller.
    limit = broadcast_rows if broadcast_rows is not None else BROADCAST_ROWS // 100
    side = broadcast_if_small(cells, limit)
    keyed = points.withColumns({"cx": _cell(F.col(lng), cell_deg), "cy": _cell(F.col(lat), cell_deg)})
    x, y = F.col(lng), F.col(lat)
    found = F.get(F.filter("polys", lambda p: _inside(p["edges"], x, y)), F.lit(0))["adcode"]
    if fallback:
        near = F.get(F.filter("polys", lambda p: _near_edge(p["edges"], x, y, eps)), F.lit(0))["adcode"]
        found = F.coalesce(found, near)
    return keyed.join(side, ["cx", "cy"], "left").withColumn(out, found).drop("cx", "cy", "polys")


# --------------------------------------------------------------------------
# Nearest neighbour inside a group
# --------------------------------------------------------------------------

# Cells along one side of a group's grid, at most; the list of a group's cells is bounded by its square.
GRID = 32
# Sites in one list, about: those of a group that may all lie in one cell are dealt to so many lists.
LIST_SITES = 65_536


def _box_distance(lng: Column, lat: Column, box: Column) -> Column:
    """No point of the box is closer than this many metres (slightly reduced)."""
    # A box may be nearer across the antimeridian.
    gap_lng = F.least(*[F.greatest(box["x0"] - x, x - box["x1"], F.lit(0.0)) for x in (lng, lng + 360.0, lng - 360.0)])
    gap_lat = F.greatest(box["y0"] - lat, lat - box["y1"], F.lit(0.0))
    # Distance to the meridian that bounds the box on the near side.
    turn = F.least(F.radians(gap_lng), F.lit(math.pi / 2))
    east_west = F.asin(F.least(F.cos(F.radians(lat)) * F.sin(turn), F.lit(1.0)))
    return F.greatest(F.radians(gap_lat), east_west) * (geo.EARTH_R * (1 - 1e-9)) - 1e-3


def _grid_cells(sites: DataFrame, grid: int, list_sites: int) -> DataFrame:
    """Distinct sites (g, sx, sy) as lists by cell, each cell with its box and one of its sites.

    A group's grid spans its own sites and has about as many cells as a cell has
    sites, ``grid`` squared at most.
    """
    extent = sites.groupBy("g").agg(F.count("*").alias("n"), F.min("sx").alias("x0"), F.min("sy").alias("y0"),
                                    F.max("sx").alias("x1"), F.max("sy").alias("y1"))
    side = F.least(F.ceil(F.pow("n", F.lit(0.25))), F.lit(grid))

    def place(v: str, low: str, high: str) -> Column:
        width = F.col(high) - F.col(low)
        share = F.when(width > 0, (F.col(v) - F.col(low)) / width).otherwise(F.lit(0.0))
        return F.least(F.floor(share * side), side - 1).cast("int")

    placed = sites.join(extent, "g").select(
        "g", "sx", "sy", (place("sx", "x0", "x1") * grid + place("sy", "y0", "y1")).alias("cell"),
        F.pmod(F.xxhash64("sx", "sy"), F.ceil(F.col("n") / list_sites)).alias("part"))
    site = F.struct("sx", "sy")
    return placed.groupBy("g", "cell", "part").agg(
        F.collect_list(site).alias("pts"), F.min(site).alias("rep"), F.min("sx").alias("x0"), F.max("sx").alias("x1"),
        F.min("sy").alias("y0"), F.max("sy").alias("y1"))


def nearest_in_group(queries: DataFrame, sites: DataFrame, key: str, group: str, grid: int = GRID,
                     list_sites: int = LIST_SITES) -> DataFrame:
    """Distance in km from each query to the nearest site of the same group (JN8).

    Queries are (key, group, lng, lat) with a unique key, sites (group, lng, lat);
    a query whose group has no site gets null. Each group has a grid of its own
    over its distinct sites. A query first meets the list of its group's occupied
    cells: the box of a cell gives a lower bound, one of its sites an upper bound,
    and only cells that can beat the best bound are opened, in one more join. No
    list grows with copies of a place, and no job runs until the result is used.
    """
    distinct = sites.select(F.col(group).alias("g"), F.col("lng").alias("sx"), F.col("lat").alias("sy")).where(
        "sx IS NOT NULL AND sy IS NOT NULL").distinct()
    cells = _grid_cells(distinct, grid, list_sites)
    directory = cells.groupBy("g", "cell").agg(
        F.min("rep").alias("rep"), F.min("x0").alias("x0"), F.max("x1").alias("x1"), F.min("y0").alias("y0"), F.max("y1").alias("y1"),
    ).groupBy("g").agg(F.collect_list(F.struct("cell", "rep", "x0", "x1", "y0", "y1")).alias("cells"))
    asked = queries.select(F.col(key).alias("q"), F.col(group).alias("g"), F.col("lng").alias("qx"), F.col("lat").alias("qy"))
    scored = F.transform("cells", lambda c: F.struct(
        c["cell"].alias("cell"), _box_distance(F.col("qx"), F.col("qy"), c).alias("lb"),
        geo.haversine_m(F.col("qx"), F.col("qy"), c["rep"]["sx"], c["rep"]["sy"]).alias("ub")))
    opened = bind(scored, lambda cs: bind(F.array_min(F.transform(cs, lambda c: c["ub"])), lambda best: F.filter(cs, lambda c: c["lb"] <= best)))
    frontier = asked.join(directory, "g", "left").select(
        "q", "g", "qx", "qy", F.explode_outer(F.transform(opened, lambda c: c["cell"])).alias("cell"))
    near = F.array_min(F.transform("pts", lambda s: geo.haversine_m(F.col("qx"), F.col("qy"), s["sx"], s["sy"])))
    return frontier.join(cells.select("g", "cell", "pts"), ["g", "cell"], "left").select("q", near.alias("d")).groupBy("q").agg(
        (F.min("d") / 1000.0).alias("d_km")).withColumnRenamed("q", key)


# Edges of the distance-to-training buckets, km.
RECALL_BUCKETS = (0.0, 0.1, 1.0, 5.0, 20.0, 100.0, 1e9)
# Edges of the error histogram, km.
ERROR_BUCKETS = (0.0, 10.0, 50.0, 200.0, 1000.0, 1e9)


def bucket_index(km: Column | str, edges: Sequence[float]) -> Column:
    """Index of the [lo, hi) bucket, null outside (JN9): a CASE, not a range join."""
    d = F.col(km) if isinstance(km, str) else km
    out = F.lit(None).cast("int")
    for i in reversed(range(len(edges) - 1)):
        out = F.when((d >= edges[i]) & (d < edges[i + 1]), F.lit(i)).otherwise(out)
    return out
