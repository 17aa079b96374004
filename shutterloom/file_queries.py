"""Registered queries over files that Spark writes from the given tables, and over operations that meet at a path, each with SQL that says the same."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shutterloom.functions import fingerprint, text
from shutterloom.operators import dedup
from shutterloom.plans import execute, organise
from shutterloom.queries import _DIRS, _DOCS, _JOURNAL, _ORD, _SKIP, _inventory, _plan, docs_items, order_items, path_items, query
from shutterloom.scratch import checkpointed, shared_dir
from shutterloom.sources import catalogue, journal, ranges
from shutterloom.sources.adapters import ITEMS_PATHS, JOURNAL_EVENTS, adapted
from shutterloom.sources.cache_store import CacheStore


def _folder(spark: SparkSession) -> str:
    return f"{shared_dir(spark)}/files-{uuid.uuid4().hex}"


def _with_files(spark: SparkSession, rows: DataFrame, use: Callable[[str], DataFrame]) -> DataFrame:
    """What `use` makes of a folder with files (name, content), which is deleted afterwards."""
    root = _folder(spark)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, base = ranges.place(root)
        made: set[str] = set()
        for batch in batches:
            for name, content in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                target = f"{base}/{name}"
                folder = target.rpartition("/")[0]
                if folder not in made:
                    system.create_dir(folder, recursive=True)
                    made.add(folder)
                # a name of its own for each attempt, then a move, so that a repeated task leaves whole files
                part = f"{target}.{uuid.uuid4().hex}"
                with system.open_output_stream(part) as out:
                    out.write(content.as_buffer())
                system.move(part, target)
            yield pa.RecordBatch.from_arrays([pa.array([batch.num_rows])], names=["n"])

    def delete(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, base = ranges.place(root)
        for batch in batches:
            for name in batch.column(0).to_pylist():
                try:
                    system.delete_file(f"{base}/{name}")
                except FileNotFoundError:
                    pass  # another attempt has deleted it
            yield pa.RecordBatch.from_arrays([pa.array([batch.num_rows])], names=["n"])

    rows.select("name", "content").mapInArrow(write, "n long").agg(F.sum("n")).first()
    try:
        return checkpointed(use(root))
    finally:
        # by tasks, as one process would take as long as many tasks wrote; what is left are folders
        rows.select("name").mapInArrow(delete, "n long").agg(F.sum("n")).first()
        system, base = ranges.place(root)
        if system.get_file_info(base).type == fs.FileType.Directory:
            system.delete_dir(base)


def _below(root: str) -> F.Column:
    """The path below the written folder."""
    base = ranges.place(root)[1]
    return F.substring("path", F.expr(f"length(path) - length(substring_index(path, '{base.rpartition('/')[2]}/', -1)) + 1"), F.length("path"))


#: Documents as files of five endings; some in hidden folders, which Spark doesn't list.
_TREE_FILES = """SELECT concat(source, CASE WHEN doc_id % 9 = 0 THEN '/.cache/' ELSE concat('/', lang, '/') END, 'f', CAST(doc_id AS STRING), CASE CAST(doc_id % 5 AS INT) WHEN 0 THEN '.jpg' WHEN 1 THEN '.MP4' WHEN 2 THEN '.txt' WHEN 3 THEN '.png' ELSE '.mov' END) AS name, text AS content, doc_id FROM documents"""


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return adapted(spark, sf_dir, _TREE_FILES).withColumn("content", F.col("content").cast("binary"))


@query(f"""WITH f AS ({_TREE_FILES}) SELECT name, CASE WHEN doc_id % 5 IN (0, 3) THEN 'image' ELSE 'video' END AS kind, CAST(octet_length(encode(content)) AS BIGINT) AS file_size
FROM f WHERE doc_id % 5 <> 2 AND doc_id % 9 > 0 AND octet_length(encode(content)) >= 1024""")
def scanned_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A folder of files, listed from two roots of which one lies in the other, as a catalogue."""

    def use(root: str) -> DataFrame:
        base = ranges.place(root)[1]
        files = None
        for r in catalogue.roots([f"{base}/wiki", f"{base}/", f"{base}/./"]):
            listed = catalogue.list_files(spark, f"file:{r}" if root.startswith(("file:", "/")) else root)
            files = listed if files is None else files.unionByName(listed)
        return catalogue.scan(files).select(_below(root).alias("name"), "kind", "file_size")

    return _with_files(spark, _documents(spark, sf_dir), use)


_SIGNED = f"""WITH f AS ({_TREE_FILES}), q AS (SELECT name, content, printf('%016x', octet_length(encode(content))) AS h FROM f WHERE content IS NOT NULL AND doc_id % 9 > 0),
s AS (SELECT name, content, sha256(unhex(concat(substr(h, 15, 2), substr(h, 13, 2), substr(h, 11, 2), substr(h, 9, 2), substr(h, 7, 2), substr(h, 5, 2), substr(h, 3, 2), substr(h, 1, 2))) || encode(content)) AS quick_signature FROM q)"""


@query(_SIGNED + " SELECT name, quick_signature, CASE WHEN count(*) OVER (PARTITION BY quick_signature) > 1 THEN sha256(content) END AS content_hash FROM s")
def file_signatures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quick signatures of files by their ends; all bytes are read only of those that share one. (Documents are shorter than both ends, so the SQL has no tail.)"""

    def use(root: str) -> DataFrame:
        listed = catalogue.list_files(spark, root)
        signed = ranges.signatures(listed).filter("error IS NULL").select("path", "file_size", "quick_signature")
        return ranges.confirmed_hashes(checkpointed(signed)).select(_below(root).alias("name"), "quick_signature", "content_hash")

    return _with_files(spark, _documents(spark, sf_dir).filter("content IS NOT NULL AND doc_id % 9 > 0"), use)


@query(f"""WITH f AS ({_TREE_FILES}) SELECT name, CASE WHEN doc_id % 6 < 4 THEN CAST(doc_id * 1000 AS BIGINT) END AS created_seconds FROM f WHERE content IS NOT NULL AND doc_id % 9 > 0""")
def file_movie_times(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Creation times of movie headers that stand at either end of a file, in both widths, cut off, or nowhere."""
    raw = 2082844800 + F.col("doc_id") * 1000
    wide = F.unhex(F.concat(F.hex(F.lit("mvhd")), F.lit("01000000"), F.lpad(F.hex(raw.cast("long")), 16, "0")))
    short = F.unhex(F.concat(F.hex(F.lit("mvhd")), F.lit("00000000"), F.lpad(F.hex(raw.cast("long")), 8, "0")))
    kind = F.col("doc_id") % 6
    body = F.when(kind == 0, F.concat(short, "content")).when(kind == 1, F.concat("content", short)).when(kind == 2, F.concat(wide, "content")).when(kind == 3, F.concat("content", wide)).when(kind == 4, F.concat("content", F.unhex(F.concat(F.hex(F.lit("mvhd")), F.lit("00"))))).otherwise(F.col("content"))
    rows = _documents(spark, sf_dir).filter("content IS NOT NULL AND doc_id % 9 > 0").withColumn("content", body)
    return _with_files(spark, rows, lambda root: ranges.container_times(catalogue.list_files(spark, root)).select(_below(root).alias("name"), "created_seconds"))


def _bitmaps(rows: DataFrame) -> DataFrame:
    """Suppliers (s_suppkey) as bitmap files of 16 x 16 pixels with 4 x 4 cells of one colour each."""

    def draw(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        r, c = np.arange(4)[:, None], np.arange(4)[None, :]
        for batch in batches:
            names, contents = [], []
            for k in batch.column(0).to_pylist():
                cells = np.stack([(k * 7 + 13 * r + 29 * c) % 256, (k * 3 + 5 * r * c) % 256, (k + 50 * r + c) % 256], 2).astype(np.uint8)
                pixels = cells.repeat(4, 0).repeat(4, 1)[::-1, :, ::-1]  # rows from below, blue first
                head = b"BM" + (54 + 768).to_bytes(4, "little") + bytes(4) + (54).to_bytes(4, "little") + (40).to_bytes(4, "little") + (16).to_bytes(4, "little") * 2 + (1).to_bytes(2, "little") + (24).to_bytes(2, "little") + bytes(24)
                names.append(f"s{k}.bmp")
                contents.append(head + pixels.tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(names), pa.array(contents, pa.binary())], names=["name", "content"])

    return rows.select("s_suppkey").mapInArrow(draw, "name string, content binary")


@query("""WITH cell AS (SELECT s_suppkey AS k, r, c FROM supplier, (SELECT unnest(range(4)) AS r), (SELECT unnest(range(4)) AS c)),
x AS (SELECT k, r, c, 0 AS ch, (k * 7 + 13 * r + 29 * c) % 256 AS v FROM cell UNION ALL SELECT k, r, c, 1, (k * 3 + 5 * r * c) % 256 FROM cell UNION ALL SELECT k, r, c, 2, (k + 50 * r + c) % 256 FROM cell)
SELECT concat('s', CAST(k AS VARCHAR), '.bmp') AS name, string_agg(CAST(v AS VARCHAR), ',' ORDER BY r, c, ch) AS colours, true AS has_hash FROM x GROUP BY k""")
def image_colours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Colour grids of image files."""

    def use(root: str) -> DataFrame:
        signed = fingerprint.image_signatures(spark.read.format("image").load(root))
        return signed.select(F.substring_index("path", "/", -1).alias("name"), F.array_join("color_sig", ",").alias("colours"), F.col("phash").isNotNull().alias("has_hash"))

    return _with_files(spark, _bitmaps(spark.read.parquet(f"{sf_dir}/supplier.parquet")), use)


@query(_SKIP + " SELECT item_id, op_kind, desired AS destination_path, op_kind = 'move' AS selected FROM ops")
def exported_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A plan exported as JSON and read again."""
    rows, operations, rule = _plan(spark, sf_dir, "skip")
    operations = checkpointed(operations)
    root = _folder(spark)
    journal.export_json(operations, organise.transfer_summary(operations), organise.warnings(rows, operations, rule, organise.Filter()), root)
    return spark.read.schema("item_id long, op_kind string, destination_path string, selected boolean").json(f"{root}/operations")


@query("""WITH p AS (SELECT DISTINCT unnest([concat('/lib/', source, '/', lang), concat('lib//', source, '/', lang, '/', CAST(doc_id % 3 AS VARCHAR), '/'), CASE WHEN doc_id % 2 = 0 THEN concat('/more/', lang) ELSE concat('/more/', lang, '/x/../y') END]) AS path FROM documents),
n AS (SELECT DISTINCT rtrim(replace(replace(concat('/', ltrim(path, '/')), '//', '/'), '/x/../', '/'), '/') AS path FROM p)
SELECT path FROM n WHERE NOT EXISTS (SELECT 1 FROM n AS o WHERE starts_with(n.path, concat(o.path, '/')))""")
def outer_roots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Folders without those that lie in another one, however they are spelled."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    deep = F.concat(F.lit("lib//"), "source", F.lit("/"), "lang", F.lit("/"), (F.col("doc_id") % 3).cast("string"), F.lit("/"))
    more = F.when(F.col("doc_id") % 2 == 0, F.concat(F.lit("/more/"), "lang")).otherwise(F.concat(F.lit("/more/"), "lang", F.lit("/x/../y")))
    paths = docs.select(F.explode(F.array(F.concat(F.lit("/lib/"), "source", F.lit("/"), "lang"), deep, more)).alias("path"))
    return catalogue.outer_roots(paths)


# ---- names, operations and entries that meet

_CHAINED = _ORD.replace("SELECT *, concat(source_root", "SELECT * REPLACE (CASE WHEN item_id % 4 = 0 THEN concat('ord', CAST(item_id % 5 AS VARCHAR), '_1.jpg') ELSE file_name END AS file_name), concat(source_root") + _DIRS


@query(_CHAINED + """,
taken AS (SELECT DISTINCT target_dir, item_id % 5 AS c FROM dirs WHERE item_id % 7 = 0 AND captured_at IS NOT NULL),
first AS (SELECT DISTINCT target_dir, item_id % 5 AS c FROM dirs WHERE item_id % 4 = 0),
turns AS (SELECT item_id, d.target_dir, item_id % 5 AS c, item_id % 4 = 0 AS one, first.c IS NOT NULL AS has_one, taken.c IS NOT NULL AS has_three, row_number() OVER (PARTITION BY d.target_dir, item_id % 5, item_id % 4 = 0 ORDER BY item_id) - 1 AS j
  FROM dirs d LEFT JOIN first ON first.target_dir = d.target_dir AND first.c = item_id % 5 LEFT JOIN taken ON taken.target_dir = d.target_dir AND taken.c = item_id % 5),
given AS (SELECT *, j + CASE WHEN has_one THEN 1 ELSE 0 END AS n FROM turns)
SELECT item_id, concat(target_dir, '/ord', CAST(c AS VARCHAR), CASE WHEN one THEN '_1' ELSE '' END, CASE WHEN j = 0 THEN '' WHEN one THEN concat('_', CAST(j AS VARCHAR)) ELSE concat('_', CAST(n + CASE WHEN has_three AND n >= 3 THEN 1 ELSE 0 END AS VARCHAR)) END, '.jpg') AS destination_path FROM given""")
def plan_chained_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names that numbers of other names would be: `ord0_1.jpg` comes first, so `ord0.jpg` goes on with 2, passing over a 3 on disk."""
    is_one = F.col("item_id") % 4 == 0
    number = (F.col("item_id") % 5).cast("string")
    items = order_items(spark, sf_dir)
    items = items.withColumns({"file_name": F.when(is_one, F.concat(F.lit("ord"), number, F.lit("_1.jpg"))).otherwise(F.col("file_name")), "scan_ordinal": F.col("item_id") + F.when(is_one, 0).otherwise(10**12)})
    items = items.withColumn("path", F.concat("source_root", F.lit("/"), F.col("item_id").cast("string"), F.lit("/"), "file_name"))
    rule, f = organise.Rule(), organise.Filter()
    rows = organise.considered(items, f)
    three = organise.prepared(rows.filter("item_id % 7 = 0 AND captured_at IS NOT NULL"), rule, f).select(F.concat("target_dir", F.lit("/ord"), number, F.lit("_3.jpg")).alias("path"))
    return organise.build(rows, rule, f, three).select("item_id", "destination_path")


_ONE_PLACE = """WITH o AS (SELECT o_orderkey AS item_id, o_orderkey % 10 > 0 AS has_source, o_orderkey % 1000 AS place, o_orderkey % 13 = 0 AS over, (o_orderkey % 1000) % 7 = 0 AS on_disk FROM orders),
s AS (SELECT *, on_disk OR coalesce(min(CASE WHEN has_source THEN item_id END) OVER (PARTITION BY place) < item_id, false) AS occupied FROM o),
e AS (SELECT *, CASE WHEN NOT has_source THEN '源文件已不存在' WHEN occupied AND NOT over THEN '目标已存在同名文件，未执行' END AS failed FROM s)"""


@query(_ONE_PLACE + """
SELECT item_id, item_id * 2 + 1 AS seq, 'move' AS op_kind, CASE WHEN failed IS NULL THEN 'success' ELSE 'failed' END AS result, coalesce(failed, '') AS message FROM e
UNION ALL SELECT item_id, item_id * 2, 'trash', 'success', '被同名文件顶替，已移入回收站（撤销可取回）' FROM e WHERE failed IS NULL AND occupied""")
def applied_to_one_place(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Operations of which many have one destination: the first with a source has it, others fail or displace what is there."""
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet").select(F.col("o_orderkey").alias("item_id"))
    key, place = F.col("item_id"), F.concat(F.lit("/out/"), (F.col("item_id") % 1000).cast("string"))
    source = F.concat(F.lit("/in/"), key.cast("string"))
    ops = orders.select("item_id", key.alias("op_ordinal"), F.lit("move").alias("op_kind"), source.alias("source_path"), place.alias("destination_path"), F.lit(1).cast("long").alias("file_size"), F.lit(True).alias("selected"), (key % 13 == 0).alias("overwrites_existing"))
    files = orders.filter("item_id % 10 > 0").select(source.alias("path")).unionByName(orders.filter("(item_id % 1000) % 7 = 0").select(place.alias("path")))
    return execute.apply_plan(ops, files, "s").select("item_id", "seq", "op_kind", "result", "message")


@query("""WITH o AS (SELECT o_orderkey AS item_id, o_orderkey % 3 AS step, (o_orderkey - o_orderkey % 3) / 3 AS chain FROM orders),
c AS (SELECT chain, bool_or(step = 0) AS has_0, bool_or(step = 1) AS has_1 FROM o GROUP BY chain)
SELECT item_id, CASE WHEN step = 0 OR (step = 1 AND has_0) OR (step = 2 AND has_1 AND has_0) THEN 'success' ELSE 'failed' END AS result FROM o JOIN c USING (chain)""")
def applied_chains(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Moves of which each takes what the one before has put there: a file goes on as far as no move of its chain is missing."""
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet").select(F.col("o_orderkey").alias("item_id"))
    step = F.col("item_id") % 3
    chain = ((F.col("item_id") - step) / 3).cast("long").cast("string")
    at = lambda s: F.concat(F.lit("/c/"), chain, F.lit("/"), s.cast("string"))
    ops = orders.select("item_id", F.col("item_id").alias("op_ordinal"), F.lit("move").alias("op_kind"), at(step).alias("source_path"), at(step + 1).alias("destination_path"), F.lit(1).cast("long").alias("file_size"), F.lit(True).alias("selected"), F.lit(False).alias("overwrites_existing"))
    return execute.apply_plan(ops, ops.select(at(F.lit(0)).alias("path")), "s").select("item_id", "result")


@query(_JOURNAL + """, e AS (SELECT session_id, seq, op_kind, seq % 3 AS o, seq % 9 > 0 AS present FROM j WHERE result = 'success' AND NOT undone AND op_kind <> 'copy'),
r AS (SELECT *, o = 0 OR (present AND row_number() OVER (PARTITION BY session_id, o, present ORDER BY seq DESC) > 1) OR (NOT present AND false) AS occupied FROM e),
t AS (SELECT *, row_number() OVER (PARTITION BY session_id, o, present AND occupied AND op_kind <> 'trash' ORDER BY seq DESC) AS k FROM r)
SELECT session_id, seq, CASE WHEN NOT present OR (op_kind = 'trash' AND occupied) THEN 'failed' ELSE 'undone' END AS undo_status,
  CASE WHEN NOT present OR (op_kind = 'trash' AND occupied) THEN NULL WHEN occupied THEN concat('/lib/o', CAST(o AS VARCHAR), '/x_', CAST(k + CASE WHEN o = 1 AND k >= 2 THEN 1 ELSE 0 END AS VARCHAR), '.jpg') ELSE concat('/lib/o', CAST(o AS VARCHAR), '/x.jpg') END AS to_path,
  CASE WHEN NOT present THEN concat('撤销失败：', CASE WHEN op_kind = 'trash' THEN '回收站中的文件已被清空，无法还原' ELSE '目标位置的副本已不存在，无法还原' END)
    WHEN op_kind = 'trash' AND occupied THEN '撤销失败：原位置已存在同名文件，未还原以免覆盖'
    WHEN occupied THEN concat('原位置已被占用，已还原为 x_', CAST(k + CASE WHEN o = 1 AND k >= 2 THEN 1 ELSE 0 END AS VARCHAR), '.jpg') END AS message FROM t""")
def undo_repeated_origins(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sessions in which many entries go back to one place, which is occupied, or whose second number is, or which is free."""
    rows = adapted(spark, sf_dir, JOURNAL_EVENTS).filter("op_kind <> 'copy'")
    now = F.concat(F.lit("/now/"), F.col("seq").cast("string"))
    trash = F.col("op_kind") == "trash"
    rows = rows.withColumns({"source_path": F.concat(F.lit("/lib/o"), (F.col("seq") % 3).cast("string"), F.lit("/x.jpg")), "destination_path": F.when(~trash, now), "trash_path": F.when(trash, now)})
    files = rows.filter("seq % 9 > 0").select(now.alias("path")).unionByName(spark.createDataFrame([("/lib/o0/x.jpg",), ("/lib/o1/x_2.jpg",)], "path string"))
    return execute.undo_plan(rows, files).select("session_id", "seq", "undo_status", "to_path", "message")


# ---- counters, cache and thresholds

@query(_ORD + ", t AS (SELECT CASE time_source WHEN 'exif' THEN 5 WHEN 'container' THEN 4 WHEN 'fileName' THEN 3 WHEN 'fileSystem' THEN 1 ELSE 0 END AS trust FROM items) SELECT count(*) AS considered, count(*) FILTER (trust < 3) AS filtered_out, CAST(0 AS BIGINT) AS excluded FROM t")
def observed_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The counters of a plan that come with its own pass over the items."""
    f = organise.Filter(minimum_confidence=3)
    rows, seen = organise.observed(organise.considered(order_items(spark, sf_dir), f))
    organise.prepared(rows, organise.Rule(), f).write.format("noop").mode("overwrite").save()
    found = seen.get
    return spark.createDataFrame([(found["considered"], found["filtered_out"], found["excluded"])], "considered long, filtered_out long, excluded long")


@query(f"""WITH base AS ({ITEMS_PATHS}), items AS (SELECT DISTINCT ON (path) path, CAST(file_size AS BIGINT) AS file_size FROM base ORDER BY path, item_id)
SELECT path, file_size % 5 > 0 AND (file_size % 3 > 0 OR file_size % 2 = 0) AS is_hit, CASE WHEN file_size % 5 = 0 THEN NULL WHEN file_size % 2 = 0 THEN 'new' WHEN file_size % 3 > 0 THEN 'old' END AS mark FROM items""")
def stored_cache(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A bucketed cache after an update: every third entry was outdated, even ones are fresh, every fifth is no longer live."""
    items = path_items(spark, sf_dir).groupBy("path").agg(F.min_by("file_size", "item_id").alias("file_size")).withColumn("file_modified", F.lit(None).cast("timestamp"))
    items = checkpointed(items)
    store = CacheStore(spark, _folder(spark), f"cache_{uuid.uuid4().hex}", 8)
    size = F.col("file_size")
    store.start(items.select("path", F.when(size % 3 == 0, size + 1).otherwise(size).alias("file_size"), "file_modified", F.lit("old").alias("mark")))
    store.update(items.filter(size % 2 == 0).withColumn("mark", F.lit("new")), items.filter(size % 5 > 0).select("path"))
    return store.lookup(items).select("path", "is_hit", "mark")
