"""The driver's tables as media catalogues. The same SQL text runs in Spark and DuckDB."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

ITEMS_DOCS = """
SELECT doc_id AS item_id, doc_id AS scan_ordinal, concat('/lib/', source) AS source_root,
  concat('/lib/', source, '/', lang) AS parent_path,
  CASE WHEN doc_id % 2 = 0 THEN concat('IMG_', CAST(2020 + doc_id % 4 AS STRING), lpad(CAST(1 + doc_id % 12 AS STRING),2,'0'), lpad(CAST(1 + doc_id % 28 AS STRING),2,'0'), '_',
        lpad(CAST(doc_id % 24 AS STRING),2,'0'), lpad(CAST(doc_id % 60 AS STRING),2,'0'), lpad(CAST(doc_id * 7 % 60 AS STRING),2,'0'), '.jpg')
       ELSE concat('DSC_', CAST(doc_id AS STRING), '.png') END AS file_name,
  'image' AS kind, n_chars AS file_size, text AS content,
  CASE lang WHEN 'en' THEN 'Apple' WHEN 'fr' THEN 'Canon' END AS make,
  CASE lang WHEN 'en' THEN 'iPhone 13' WHEN 'fr' THEN 'Canon EOS R6' WHEN 'de' THEN 'Pixel 8' END AS model,
  CAST(400 * (1 + doc_id % 4) AS INT) AS width, CAST(300 * (1 + doc_id % 4) AS INT) AS height,
  CASE CAST(doc_id % 5 AS INT) WHEN 0 THEN 'exif' WHEN 1 THEN 'container' WHEN 2 THEN 'fileName' WHEN 3 THEN 'fileSystem' ELSE 'none' END AS time_source
FROM documents"""

FRAMES_VEC = """
SELECT CAST((vec_id - vec_id % 5) / 5 AS BIGINT) AS video_id, CAST(vec_id % 5 AS INT) AS frame_idx, vec_id, embedding AS coeffs FROM embeddings"""

ITEMS_PATHS = """
SELECT page_id AS item_id, '/web' AS source_root, concat('/web/', regexp_extract(url, '^https?://([^?#]+)', 1)) AS path, length(html) AS file_size FROM pages"""

JOURNAL_EVENTS = """
SELECT user_id AS session_id, event_id AS seq, ts,
  CASE event_type WHEN 'purchase' THEN 'move' WHEN 'click' THEN 'rename' WHEN 'view' THEN 'copy' WHEN 'signup' THEN 'trash' ELSE 'move' END AS op_kind,
  CASE WHEN event_type = 'error' THEN 'failed' ELSE 'success' END AS result,
  event_id % 10 = 0 AS undone, CAST(round(value * 100) AS BIGINT) AS file_size, concat('/lib/e', CAST(event_id AS STRING)) AS source_path FROM events"""

ITEMS_ORDERS = """
SELECT o_orderkey AS item_id, o_orderkey AS scan_ordinal, concat('/lib/', o_orderstatus) AS source_root,
  concat('ord', CAST(o_orderkey % 5 AS STRING), '.jpg') AS file_name, 'image' AS kind,
  CASE WHEN o_orderpriority = '5-LOW' THEN NULL ELSE o_orderdate END AS captured_at,
  CASE o_orderpriority WHEN '1-URGENT' THEN 'exif' WHEN '2-HIGH' THEN 'container' WHEN '3-MEDIUM' THEN 'fileName' WHEN '4-NOT SPECIFIED' THEN 'fileSystem' ELSE 'none' END AS time_source,
  c_mktsegment AS model, CAST(floor(o_totalprice) AS BIGINT) AS file_size FROM orders JOIN customer ON o_custkey = c_custkey"""

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")


def adapted(spark: SparkSession, sf_dir: str, sql: str) -> DataFrame:
    """`sql` over the Parquet tables of `sf_dir`; only the tables that it reads are opened."""
    used = {t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in TABLES if re.search(rf"(FROM|JOIN) {t}\b", sql)}
    for t in used:
        sql = re.sub(rf"(FROM|JOIN) {t}\b", rf"\1 {{{t}}}", sql)
    # braces that count repetitions in patterns aren't parameters
    return spark.sql(re.sub(r"\{(\d[\d,]*)\}", r"{{\1}}", sql), **used)
