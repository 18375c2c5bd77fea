"""The operators as named queries over whole tables, with SQL twins where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from countygeo.llm import (alignment, decontamination, embedding_dedup, html_text, jaccard_join, language, packing, personal_data,
                           quality, secrets, sharding, toxicity, whitening)

Query = Callable[[SparkSession, str], DataFrame]


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _count(spans: Column, kind: str) -> Column:
    return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long")


def op1_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.find_secrets(_table(spark, sf_dir, "documents"))
    spans = F.col("secrets")
    base = F.filter(spans, lambda s: s["kind"].isin(*secrets.BASE_KINDS))
    return found.select("doc_id", *[_count(spans, k).alias(f"n_{k}") for k in secrets.KINDS],
                        F.sha2(secrets.listed(base), 256).alias("base_sha256"), secrets.listed(spans).alias("spans"))


def op2_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = personal_data.find_personal_data(_table(spark, sf_dir, "documents"))
    spans = F.col("spans")
    base = F.filter(spans, lambda s: s["kind"].isin(*personal_data.BASE_KINDS))
    return found.select("doc_id", *[_count(spans, k).alias(f"n_{k}") for k in personal_data.KINDS],
                        F.sha2(personal_data.listed(base), 256).alias("base_sha256"), personal_data.listed(spans).alias("spans"))


def op3_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup.near_vectors(_table(spark, sf_dir, "embeddings"))


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_table(spark, sf_dir, "documents"))


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = toxicity.grade(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))
    return scored.select("doc_id", "held_out", "score", "predicted", F.size("toxic_spans").cast("long").alias("n_spans"))


def op6_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.identify(_table(spark, sf_dir, "documents")).select("doc_id", "held_out", "lang_pred", "score", "rejected")


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontamination.contamination(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", "n_items", F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256"),
                        "contaminated")


def op8_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.jaccard_groups(_table(spark, sf_dir, "documents"))


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = quality.grade(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))
    return scored.select("doc_id", "held_out", "score", "predicted")


def op10_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract_main_text(_table(spark, sf_dir, "pages"))


def op11_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = sharding.shard_documents(_table(spark, sf_dir, "documents"))
    return placed.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot",
                         F.lit(None).cast("int").alias("grown_shard"))


def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = _table(spark, sf_dir, "embeddings")
    model = whitening.fit_whitening(vectors)
    return whitening.by_component(whitening.whiten(vectors, model), model)


def op13_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = alignment.align_tokenizers(_table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_a", "n_b", "n_groups", F.col("n_groups").alias("n_links"), "n_best", "count_sum", "groups_sha256")


_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: Components of the pairs in ``links(a, b)`` (both directions) over ``nodes(id)``: least id reachable.
_REACH = """
reach(id, low) AS (
  SELECT id, id FROM nodes
  UNION
  SELECT l.b, r.low FROM reach r JOIN links l ON l.a = r.id WHERE r.low < l.b
),
component AS (SELECT id, min(low) AS component_id FROM reach GROUP BY id)
"""

OP3_SQL = f"""
WITH RECURSIVE
nodes AS (SELECT vec_id AS id, label, embedding::DOUBLE[] AS x FROM embeddings),
usable AS (SELECT id, label, x, sqrt(list_dot_product(x, x)) AS norm FROM nodes WHERE label IS NOT NULL),
links AS (
  SELECT p.id AS a, q.id AS b FROM usable p JOIN usable q ON p.label = q.label AND p.id <> q.id
  WHERE list_dot_product(p.x, q.x) / (p.norm * q.norm) >= 0.98),
{_REACH}
SELECT c.id AS vec_id, (SELECT count(*) FROM links l WHERE l.a = c.id) AS n_links, component_id, c.id = component_id AS kept
FROM component c
"""

OP7_SQL = f"""
WITH
words AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w
          FROM documents),
items AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w
          FROM benchmark),
windows AS (
  SELECT DISTINCT item_id, least(len(w), 13) AS n, array_to_string(w[i:i + least(len(w), 13) - 1], ' ') AS s
  FROM (SELECT item_id, w, unnest(generate_series(1, greatest(len(w) - 12, 1))) AS i FROM items WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT n FROM windows),
found AS (
  SELECT d.doc_id, d.i, d.n, x.item_id
  FROM (SELECT doc_id, n, i, array_to_string(w[i:i + n - 1], ' ') AS s
        FROM (SELECT doc_id, w, n, unnest(generate_series(1, len(w) - n + 1)) AS i FROM words, sizes WHERE len(w) >= n)) d
  JOIN windows x ON x.n = d.n AND x.s = d.s),
hits AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(generate_series(i, i + n - 1)) AS p FROM found) GROUP BY doc_id),
named AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items
          FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS item FROM found) GROUP BY doc_id)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM words LEFT JOIN hits USING (doc_id) LEFT JOIN named USING (doc_id)
"""

OP8_SQL = f"""
WITH RECURSIVE
words AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
shingles AS (
  SELECT DISTINCT doc_id, array_to_string(w[i:i + 2], ' ') AS s
  FROM (SELECT doc_id, w, unnest(generate_series(1, greatest(len(w) - 2, 1))) AS i FROM words WHERE len(w) > 0)),
nodes AS (SELECT doc_id AS id, (SELECT count(*) FROM shingles s WHERE s.doc_id = w.doc_id) AS n FROM words w),
links AS (
  SELECT c.a, c.b
  FROM (SELECT p.doc_id AS a, q.doc_id AS b, count(*) AS k FROM shingles p JOIN shingles q ON p.s = q.s AND p.doc_id <> q.doc_id
        GROUP BY ALL) c
  JOIN nodes x ON x.id = c.a JOIN nodes y ON y.id = c.b
  WHERE 100 * c.k >= 90 * (x.n + y.n - c.k)),
{_REACH}
SELECT c.id AS doc_id, n AS n_shingles, component_id, (SELECT count(*) FROM links l WHERE l.a = c.id) AS n_links
FROM component c JOIN nodes USING (id)
"""


def queries() -> dict[str, Query]:
    found = (op1_secret_scan, op2_personal_data, op3_embedding_dedup, op4_packing, op5_toxicity, op6_language, op7_decontamination,
             op8_jaccard_join, op9_quality, op10_html_text, op11_sharding, op12_whitening, op13_alignment)
    return {f.__name__: f for f in found}


def oracle_sql() -> dict[str, str]:
    return {"op3_embedding_dedup": OP3_SQL, "op7_decontamination": OP7_SQL, "op8_jaccard_join": OP8_SQL}
