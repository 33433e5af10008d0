"""Views over the given tables that stand for images, annotations, requests, prompts and uploads.

Each statement is plain SQL that Spark and DuckDB run alike; ``VIEWS`` keeps the order in which they build on each other.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

from ..session import table

VIEWS = {
    "fx_images": """
SELECT p_partkey AS image_id, p_brand AS project,
       lower(p_type) || '/img_' || lpad(CAST(p_partkey AS STRING), 6, '0') ||
         CASE p_partkey % 6 WHEN 0 THEN '.png' WHEN 1 THEN '.JPG' WHEN 2 THEN '.npy' WHEN 3 THEN '.tiff' WHEN 4 THEN '.txt' ELSE '' END AS path,
       CAST(100 + (p_partkey * 37) % 5000 AS INT) AS width,
       CAST(80 + (p_partkey * 53) % 4000 AS INT) AS height,
       CAST(1 + p_size % 9 AS INT) AS num_bands,
       CAST(floor(p_retailprice) AS BIGINT) * 40000 AS size_bytes
FROM part""",
    "fx_categories": "SELECT CAST(n_nationkey * 3 + 1 AS BIGINT) AS category_id, n_name AS name FROM nation",
    "fx_annotations": """
SELECT ((l_orderkey * 8 + l_linenumber) * 100000 + l_partkey) * 10000 + l_suppkey AS annotation_id,
       l_partkey AS image_id,
       CAST(((l_suppkey + l_partkey) % 27) * 3 + 1 AS BIGINT) AS category_id,
       CASE l_linenumber % 3 WHEN 0 THEN 'point' WHEN 1 THEN 'bounding_box' ELSE 'polygon' END AS kind,
       CAST(min(l_quantity) * 17 - 20 AS FLOAT) AS x,
       CAST(min(l_discount) * 9000 + l_linenumber AS FLOAT) AS y,
       CAST(min(l_quantity) * 3 + 1 AS FLOAT) AS w,
       CAST(min(l_tax) * 2500 + 2 AS FLOAT) AS h
FROM lineitem
GROUP BY l_orderkey, l_linenumber, l_partkey, l_suppkey""",
    "fx_vertices": """
SELECT a.annotation_id, v.ord,
       CAST(CAST(a.x AS DOUBLE) + CAST(a.w AS DOUBLE) * v.dx / 2 AS FLOAT) AS vx,
       CAST(CAST(a.y AS DOUBLE) + CAST(a.h AS DOUBLE) * v.dy / 2 AS FLOAT) AS vy
FROM fx_annotations a CROSS JOIN (VALUES (0, 0, 0), (1, 2, 0), (2, 2, 2), (3, 1, 1), (4, 0, 2)) AS v(ord, dx, dy)
WHERE a.kind = 'polygon'""",
    "fx_request_log": """
SELECT event_id, ts, user_id,
       CASE user_id % 3 WHEN 0 THEN 'image_bands' WHEN 1 THEN 'sam_infer' ELSE 'sam_warm' END AS endpoint,
       CAST(floor(value) AS BIGINT) AS latency_ms,
       event_type <> 'error' AS ok,
       CASE WHEN event_type = 'error' THEN
         CASE event_id % 7 WHEN 0 THEN 1000 WHEN 1 THEN 1003 WHEN 2 THEN 2000 WHEN 3 THEN 3015 WHEN 4 THEN 4006 WHEN 5 THEN 5000 ELSE 9999 END
       END AS error_code
FROM events""",
    "fx_prompts": """
SELECT event_id AS prompt_id, user_id AS image_id,
       CAST(event_id % 4 AS INT) AS r, CAST(event_id % 11 AS INT) AS g, 2 AS b,
       CAST(value * 8 AS FLOAT) AS px, CAST(value * 5 AS FLOAT) AS py,
       CASE WHEN event_type = 'view' THEN 0 ELSE 1 END AS label,
       event_type = 'purchase' AS has_box
FROM events""",
    "fx_build_status": """
SELECT p_partkey AS image_id,
       CASE p_size % 6 WHEN 0 THEN ' ready ' WHEN 1 THEN 'building' WHEN 2 THEN 'failed: io' WHEN 3 THEN 'unknown' WHEN 4 THEN 'ready' END AS status_text
FROM part""",
    "fx_upload_names": """
SELECT page_id, page_id % 40 AS upload_id,
       CASE page_id % 7 WHEN 0 THEN url WHEN 1 THEN 'a/./b//img ' || CAST(page_id AS STRING) || '.png' WHEN 2 THEN '../up.png'
                        WHEN 3 THEN '/abs.png' WHEN 4 THEN 'set/part.txt' WHEN 5 THEN '   ' ELSE 'nested/x' || CAST(page_id AS STRING) || '.NPY' END AS raw_name,
       length(html) AS size_bytes
FROM pages""",
}
#: The two dialects explode arrays differently.
VALUES_SPARK = "SELECT vec_id, p.pos AS i, p.col AS v FROM embeddings LATERAL VIEW posexplode(embedding) p AS pos, col"
VALUES_DUCKDB = "SELECT vec_id, generate_subscripts(embedding, 1) - 1 AS i, unnest(embedding) AS v FROM embeddings"
TABLES = ("nation", "part", "lineitem", "events", "pages", "embeddings")


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A view by name, on the tables of ``sf_dir``."""
    needed = {"fx_vertices": ("lineitem",), "fx_annotations": ("lineitem",), "fx_images": ("part",), "fx_categories": ("nation",), "fx_request_log": ("events",), "fx_prompts": ("events",), "fx_build_status": ("part",), "fx_upload_names": ("pages",), "fx_values": ("embeddings",)}
    frames = {t: table(spark, sf_dir, t) for t in needed[name]}
    if name == "fx_vertices":
        return spark.sql(VIEWS[name].replace("fx_annotations a", "{fx_annotations} a"), fx_annotations=view(spark, sf_dir, "fx_annotations"))
    text = VALUES_SPARK if name == "fx_values" else VIEWS[name]
    source = needed[name][0]
    return spark.sql(text.replace(f"FROM {source}", f"FROM {{{source}}}"), **frames)


def rows(spark: SparkSession, sf_dir: str, text: str) -> DataFrame:
    """SQL over the views and the given tables, both named as they are."""
    names = set(re.findall(r"\b(?:FROM|JOIN)\s+(fx_\w+|region|nation|customer|supplier|part|orders|lineitem|events|pages|embeddings)\b", text))
    frames = {n: view(spark, sf_dir, n) if n.startswith("fx_") else table(spark, sf_dir, n) for n in names}
    text = text.replace("{", "{{").replace("}", "}}")
    return spark.sql(re.sub(r"\b(FROM|JOIN)\s+(\w+)\b", lambda m: f"{m[1]} {{{m[2]}}}" if m[2] in names else m[0], text), **frames)


def with_views(sql: str) -> str:
    """DuckDB SQL that may name the views."""
    named = {**VIEWS, "fx_values": VALUES_DUCKDB}
    used = [n for n in named if n in sql]
    if "fx_vertices" in used and "fx_annotations" not in used:
        used.insert(used.index("fx_vertices"), "fx_annotations")
    heads = ", ".join(f"{n} AS ({named[n].strip()})" for n in used)
    body = sql.strip()
    if body.upper().startswith("WITH RECURSIVE "):
        return f"WITH RECURSIVE {heads}, {body[15:]}" if heads else body
    if body.upper().startswith("WITH "):
        return f"WITH {heads}, {body[5:]}" if heads else body
    return f"WITH {heads} {body}" if heads else body
