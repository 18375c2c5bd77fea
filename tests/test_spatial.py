import random

import numpy as np

from countygeo.operators import spatial as spt


def ring_edges(ord_, code, *rings):
    return [(code, ord_, float(a[0]), float(a[1]), float(b[0]), float(b[1])) for ring in rings for a, b in zip(ring, ring[1:] + ring[:1])]


EDGES = (
    # Square with a hole, a two-part feature, and a feature that overlaps the first one.
    ring_edges(1, "100001", [(0, 0), (1, 0), (1, 1), (0, 1)], [(0.4, 0.4), (0.6, 0.4), (0.6, 0.6), (0.4, 0.6)])
    + ring_edges(2, "100002", [(2, 0), (2.5, 0), (2.5, 0.5), (2, 0.5)], [(3, 1), (3.37, 1), (3.11, 1.5)])
    + ring_edges(3, "100003", [(0.3, 0.3), (1.5, 0.3), (1.5, 0.7), (0.3, 0.7)])
)


def ray_cast(x, y):
    for ord_ in (1, 2, 3):
        mine = [e for e in EDGES if e[1] == ord_]
        odd = False
        for _, _, x1, y1, x2, y2 in mine:
            if (y1 > y) != (y2 > y) and x < (x2 - x1) * (y - y1) / (y2 - y1) + x1:
                odd = not odd
        if odd:
            return mine[0][0]
    return None


def frames(spark, pts):
    edges = spark.createDataFrame(EDGES, "adcode string, ord int, x1 double, y1 double, x2 double, y2 double")
    return spark.createDataFrame(pts, "id int, lng double, lat double"), spt.polygon_cells(edges)


def test_locate_against_ray_casting(spark):
    rng = random.Random(1)
    pts = [(i, rng.uniform(-0.2, 3.6), rng.uniform(-0.2, 1.7)) for i in range(400)]
    df, cells = frames(spark, pts)
    want = {i: ray_cast(x, y) for i, x, y in pts}
    assert {r.id: r.located for r in spt.locate(df, cells).collect()} == want
    assert {r.id: r.located for r in spt.locate(df, cells, broadcast_rows=0).collect()} == want


def test_boundary_only_with_fallback(spark):
    df, cells = frames(spark, [(0, 1.0, 0.1), (1, 1.000005, 0.1), (2, 1.01, 0.1), (3, 0.5, 0.5), (4, 2.25, 0.0)])
    plain = {r.id: r.located for r in spt.locate(df, cells).collect()}
    assert plain == {0: None, 1: None, 2: None, 3: "100003", 4: None}
    near = {r.id: r.located for r in spt.locate(df, cells, fallback=True).collect()}
    assert near == {0: "100001", 1: "100001", 2: None, 3: "100003", 4: "100002"}


def test_location_is_a_cell_join(spark):
    df, cells = frames(spark, [(0, 0.1, 0.1)])
    plan = spt.locate(df, cells, broadcast_rows=0)._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_nearest_against_brute_force(spark):
    rng = np.random.default_rng(4)
    sites, queries = [], []
    for g, spread in (("a", 0.01), ("b", 2.0), ("c", 0.3)):
        for x, y in rng.uniform(0, spread, (150, 2)):
            sites.append((g, 100 + float(x), 30 + float(y)))
        for x, y in rng.uniform(-spread, 2 * spread, (40, 2)):
            queries.append((len(queries), g, 100 + float(x), 30 + float(y)))
    sites += [("a", 100.005, 30.005)] * 500
    queries += [(900, "none", 1.0, 1.0), (901, "c", -60.0, -40.0)]
    q = spark.createDataFrame(queries, "id int, g string, lng double, lat double")
    s = spark.createDataFrame(sites, "g string, lng double, lat double")
    got = {r.id: r.d_km for r in spt.nearest_in_group(q, s, "id", "g").collect()}
    split = {r.id: r.d_km for r in spt.nearest_in_group(q, s, "id", "g", grid=2, list_sites=5).collect()}
    assert split == got
    assert got[900] is None and len(got) == len(queries)
    for i, g, x, y in queries:
        if g == "none":
            continue
        p = np.radians([t[1:] for t in sites if t[0] == g])
        a, b = np.radians(x), np.radians(y)
        h = np.sin((p[:, 1] - b) / 2) ** 2 + np.cos(b) * np.cos(p[:, 1]) * np.sin((p[:, 0] - a) / 2) ** 2
        assert abs(got[i] - float((2 * 6371.0088 * np.arcsin(np.sqrt(h))).min())) < 1e-6


def test_buckets(spark):
    rows = spark.createDataFrame([(0.0,), (0.1,), (99.9,), (100.0,), (None,)], "d double")
    assert [r[0] for r in rows.select(spt.bucket_index("d", spt.RECALL_BUCKETS)).collect()] == [0, 1, 4, 5, None]
