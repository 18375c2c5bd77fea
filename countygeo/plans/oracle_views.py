"""SQL twins of the fixture tables and of the intermediate results."""

from __future__ import annotations

import re

HAV = ("12742017.6 * asin(sqrt(least(1.0, greatest(0.0, "
       "sin((radians({b2}) - radians({b1})) / 2) * sin((radians({b2}) - radians({b1})) / 2) + "
       "cos(radians({b1})) * cos(radians({b2})) * "
       "sin((radians({a2}) - radians({a1})) / 2) * sin((radians({a2}) - radians({a1})) / 2)))))")


def hav(a1: str, b1: str, a2: str, b2: str) -> str:
    """Great-circle metres between (a1, b1) and (a2, b2)."""
    return HAV.format(a1=a1, b1=b1, a2=a2, b2=b2)


def gx(size: float, lng: str = "lng", lat: str = "lat") -> str:
    return f"trunc({lng} * 111320.0 * greatest(cos(radians({lat})), 1e-6) / {size})::BIGINT"


def gy(size: float, lat: str = "lat") -> str:
    return f"trunc({lat} * 111320.0 / {size})::BIGINT"


def draw(seed: str, *cols: str) -> str:
    """Uniform double from the digest of seed and columns."""
    text = " || '|' || ".join([f"'{seed}'", *[f"({c})::VARCHAR" for c in cols]])
    return f"(('0x' || substr(md5({text}), 1, 13))::BIGINT / 4503599627370496.0::DOUBLE)"


def digest(seed: str, *cols: str) -> str:
    text = " || '|' || ".join([f"'{seed}'", *[f"({c})::VARCHAR" for c in cols]])
    return f"md5({text})"


SEED = "20260926"
QUOTA = "CASE WHEN adcode LIKE '51%' THEN 10 ELSE 5 END"

VIEWS: dict[str, str] = {
    "fx_panos": """
SELECT
  CASE WHEN n % 12 = 11 THEN '230' ELSE lpad(CAST(90 + n % 12 AS VARCHAR), 3, '0') END
    || lpad(CAST(n AS VARCHAR), 3, '0')
    || lpad(CAST(n * 4 + o_orderkey % 4 AS VARCHAR), 4, '0')
    || strftime(m, '%y%m%d')
    || lpad(CAST(o_orderkey AS VARCHAR), 9, '0')
    || CASE WHEN o_orderkey % 4 = 3 AND n % 5 = 4 THEN 'IN' ELSE '5' || chr(CAST(65 + n AS INT)) END AS panoid,
  CASE r WHEN 0 THEN '51' WHEN 1 THEN '11' WHEN 2 THEN '31' WHEN 3 THEN '44' ELSE '65' END
    || CASE WHEN n = 24 THEN '90' ELSE lpad(CAST(n AS VARCHAR), 2, '0') END
    || lpad(CAST(d + 1 AS VARCHAR), 2, '0') AS adcode,
  CAST(75 + n * 2.0 + d * 0.2 + (o_orderkey % 20) * 0.001 AS DOUBLE) AS lng,
  CAST(20 + r * 6.0 + d * 0.2 + (CAST(floor(o_orderkey / 20) AS BIGINT) % 20) * 0.001 AS DOUBLE) AS lat,
  strftime(m, '%Y%m%d') AS date8,
  CASE WHEN o_orderkey % 50 = 0 THEN 'hidden' ELSE 'normal' END AS kind,
  CASE o_orderkey % 10 WHEN 9 THEN 'failed' WHEN 8 THEN 'api' ELSE 'local' END AS adcode_status
FROM (SELECT o_orderkey, o_custkey % 8 AS d, n_nationkey AS n, n_regionkey AS r,
             date_trunc('month', o_orderdate) AS m
      FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey)""",
    "fx_samples": """
SELECT panoid, adcode, CASE WHEN adcode LIKE '51%' THEN 'sichuan' ELSE 'national' END AS part, lng, lat,
       substr(panoid, 1, 3) || '_' || substr(panoid, 7, 4) || '_' || right(panoid, 2) AS vehicle, date8 AS date,
       substr(panoid, 4, 3) AS city,
       CASE WHEN adcode LIKE '51%' THEN 2048 ELSE 1024 END AS width,
       CASE WHEN adcode LIKE '51%' THEN 1024 ELSE 512 END AS height,
       100000 + substr(panoid, 17, 9)::BIGINT % 977 * 331 AS bytes,
       substr(panoid, 1, 3) || '_' || substr(panoid, 7, 4) || '_' || right(panoid, 2) || '|' || date8 AS gid
FROM fx_panos WHERE kind = 'normal'""",
    "fx_poly_edges": """
SELECT a.adcode, a.adcode::BIGINT AS ord, a.i, a.px AS x1, a.py AS y1, b.px AS x2, b.py AS y2
FROM fx_poly_points a JOIN fx_poly_points b ON a.adcode = b.adcode AND b.i = (a.i + 1) % 6""",
    "fx_poly_points": """
SELECT adcode, i,
   CAST(x + CASE WHEN i IN (0, 5) THEN -0.0055 WHEN i IN (1, 2) THEN 0.0255 ELSE 0.0105 END AS DOUBLE) AS px,
   CAST(y + CASE WHEN i IN (0, 1) THEN -0.0055 WHEN i IN (2, 3) THEN 0.0105 ELSE 0.0255 END AS DOUBLE) AS py
FROM (SELECT adcode, x, y, unnest([0,1,2,3,4,5]) AS i
      FROM (SELECT DISTINCT adcode, floor(round(lng * 1000) / 200)::BIGINT * 0.2 AS x,
                   floor(round(lat * 1000) / 200)::BIGINT * 0.2 AS y FROM fx_panos))""",
    "fx_classes": """
SELECT adcode, lng, lat, CAST(row_number() OVER (ORDER BY adcode) - 1 AS INT) AS class_idx
FROM (SELECT adcode, avg(lng) AS lng, avg(lat) AS lat FROM fx_panos GROUP BY adcode)""",
    "fx_targets": """
SELECT vec_id AS sample_id, embedding, CAST((label * 37 + vec_id) % (SELECT count(*) FROM fx_classes) AS INT) AS target
FROM embeddings""",
    "fx_scores": """
SELECT sample_id, target, class_idx,
  CAST(embedding[class_idx % 64 + 1] AS DOUBLE) * 10.0::DOUBLE
  + CAST(embedding[(class_idx + (class_idx // 64) * 5 + 11) % 64 + 1] AS DOUBLE)
  + CASE WHEN class_idx = target AND sample_id % 3 <> 0 THEN 2.0::DOUBLE ELSE 0.0::DOUBLE END AS logit
FROM fx_targets, (SELECT class_idx FROM fx_classes)""",
    "fx_ranked": """
SELECT sample_id, target, class_idx, logit,
  row_number() OVER (PARTITION BY sample_id ORDER BY logit DESC, class_idx) AS rnk FROM fx_scores""",
    "fx_probs": """
SELECT sample_id, target, class_idx, rnk, e / sum(e) OVER (PARTITION BY sample_id) AS p
FROM (SELECT *, exp(logit - max(logit) OVER (PARTITION BY sample_id)) AS e FROM fx_ranked)""",
    "fx_truth": """
SELECT sample_id, target, adcode AS truth, lng + (sample_id % 20 - 10) * 0.02::DOUBLE AS truth_lng,
       lat + (sample_id % 15 - 7) * 0.02::DOUBLE AS truth_lat
FROM fx_targets JOIN fx_classes ON target = class_idx""",
    "fx_fetch_log": """
SELECT event_id, user_id AS key, ts AS updated,
  CASE event_type WHEN 'view' THEN 'pending_meta' WHEN 'click' THEN 'meta_ok' WHEN 'signup' THEN 'meta_fail'
                  WHEN 'purchase' THEN 'done' ELSE 'fail' END AS state,
  CAST(round(value * 100) AS BIGINT) AS bytes
FROM events""",
    "fx_scan": """
SELECT panoid, lng, lat, adcode FROM fx_panos
WHERE kind = 'normal' AND adcode IS NOT NULL AND adcode_status IN ('local', 'api')
  AND lng IS NOT NULL AND lat IS NOT NULL""",
    "fx_kept": "SELECT * FROM fx_scan WHERE NOT starts_with(panoid, '230')",
    "fx_cand": """
SELECT panoid, adcode, round_even(lng, 6) AS lng, round_even(lat, 6) AS lat,
  CASE WHEN adcode LIKE '51%' THEN 'sichuan' ELSE 'national' END AS part,
  substr(panoid, 1, 3) || '_' || substr(panoid, 7, 4) || '_' || right(panoid, 2) AS vehicle,
  substr(panoid, 11, 6) AS date, substr(panoid, 4, 3) AS city
FROM fx_kept WHERE length(panoid) >= 16""",
    "fx_reservoir": f"""
SELECT panoid, adcode, lng, lat, part, vehicle, date, city FROM (
  SELECT *, row_number() OVER (PARTITION BY adcode ORDER BY {digest(SEED, 'panoid')}, panoid) AS rn FROM fx_cand)
WHERE rn <= 4 * ({QUOTA})""",
    "fx_pool": f"""
SELECT panoid, adcode, lng, lat, part, vehicle, date, city FROM (
  SELECT *, row_number() OVER (PARTITION BY adcode ORDER BY o, panoid) AS rn FROM (
    SELECT *, row_number() OVER (PARTITION BY adcode, {gx(300.0)}, {gy(300.0)} ORDER BY o, panoid) AS cell_rn
    FROM (SELECT *, {digest(SEED + '/thin', 'panoid')} AS o FROM fx_reservoir))
  WHERE cell_rn = 1)
WHERE rn <= {QUOTA}""",
    "fx_points": f"""
SELECT adcode, CAST(rn - 1 AS INT) AS seq, lng, lat FROM (
  SELECT *, row_number() OVER (PARTITION BY adcode ORDER BY panoid) AS rn FROM (
    SELECT *, row_number() OVER (PARTITION BY adcode, {gx(1000.0)}, {gy(1000.0)} ORDER BY panoid) AS cell_rn FROM fx_kept)
  WHERE cell_rn = 1)
WHERE rn <= 500""",
    "fx_eligible": """
SELECT adcode, row_number() OVER (ORDER BY adcode) - 1 AS pos FROM (
  SELECT adcode FROM fx_samples WHERE adcode LIKE '51%' GROUP BY adcode HAVING count(*) >= 5)""",
    "fx_holdout": """
SELECT adcode FROM fx_eligible WHERE pos IN (
  SELECT trunc(i * ((SELECT count(*) FROM fx_eligible)::DOUBLE / 5))::BIGINT FROM range(5) t(i))""",
    "fx_groups": """
SELECT gid, bool_or(adcode IN (SELECT adcode FROM fx_holdout)) AS held, bool_and(part = 'national') AS all_other
FROM fx_samples GROUP BY gid""",
    "fx_same": f"""
SELECT DISTINCT gid FROM (
  SELECT gid, adcode, coalesce(sum(cnt) OVER (PARTITION BY adcode ORDER BY {digest(SEED + '/same', 'gid')}, gid
           ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
  FROM (SELECT gid, adcode, count(*) AS cnt FROM fx_samples JOIN fx_groups USING (gid)
        WHERE NOT held AND NOT all_other AND adcode LIKE '51%' GROUP BY gid, adcode))
WHERE before < 3""",
    "fx_other": f"""
SELECT gid FROM (
  SELECT gid, row_number() OVER (ORDER BY {digest(SEED + '/other', 'gid')}, gid) AS rn, count(*) OVER () AS n
  FROM fx_groups WHERE NOT held AND all_other)
WHERE rn <= floor(n * 0.1::DOUBLE)""",
    "fx_split": """
SELECT panoid, CASE WHEN held THEN 'test_county'
   WHEN gid IN (SELECT gid FROM fx_same) THEN 'val_same'
   WHEN gid IN (SELECT gid FROM fx_other) THEN 'val_national' ELSE 'train' END AS split
FROM fx_samples JOIN fx_groups USING (gid)""",
    "fx_train": "SELECT s.* FROM fx_samples s JOIN fx_split USING (panoid) WHERE split = 'train'",
    "fx_state": """
SELECT key, state, bytes, updated, event_id FROM (
  SELECT *, row_number() OVER (PARTITION BY key ORDER BY updated DESC, event_id DESC) AS rn FROM fx_fetch_log)
WHERE rn = 1""",
    "fx_soft": f"""
SELECT i AS class_i, j AS class_j, w / sum(w) OVER (PARTITION BY i) AS w FROM (
  SELECT a.class_idx AS i, b.class_idx AS j,
         exp(-{hav('a.lng', 'a.lat', 'b.lng', 'b.lat')} / (50000.0 / ln(2.0::DOUBLE))) AS w
  FROM fx_classes a, fx_classes b)""",
}

_WORD = re.compile(r"\bfx_[a-z_0-9]+\b")


def with_views(sql: str, extra: dict[str, str] | None = None) -> str:
    """Prefix ``sql`` with the views it needs, dependencies first."""
    known = {**VIEWS, **(extra or {})}
    ordered: list[str] = []

    def visit(name: str) -> None:
        if name in ordered or name not in known:
            return
        for dep in dict.fromkeys(_WORD.findall(known[name])):
            if dep != name:
                visit(dep)
        ordered.append(name)

    for name in dict.fromkeys(_WORD.findall(sql)):
        visit(name)
    if not ordered:
        return sql.strip()
    recursive = "RECURSIVE " if any("UNION ALL" in known[n] and re.search(rf"\b{n}\b", known[n]) for n in ordered) else ""
    ctes = ",\n".join(f"{n} AS ({known[n].strip()})" for n in ordered)
    return f"WITH {recursive}{ctes}\n{sql.strip()}"
