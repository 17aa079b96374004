"""The registered queries over the driver's tables, with SQL that says the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from shutterloom.functions import capture, fingerprint, templates, text
from shutterloom.operators import dedup, similarity, views
from shutterloom.plans import execute, organise
from shutterloom.schema import confidence
from shutterloom.sources import catalogue, journal
from shutterloom.sources.adapters import FRAMES_VEC, ITEMS_DOCS, ITEMS_ORDERS, ITEMS_PATHS, JOURNAL_EVENTS, adapted

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def docs_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = adapted(spark, sf_dir, ITEMS_DOCS)
    path = F.concat("parent_path", F.lit("/"), "file_name")
    return items.withColumns({"path": path, "captured_at": capture.capture_ts_from_name(F.col("file_name"))}).withColumn("identity", fingerprint.content_identity(fingerprint.content_hash(F.col("content")), F.lit(None).cast("string"), F.col("item_id"))).drop("content")


def frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = adapted(spark, sf_dir, FRAMES_VEC)
    return rows.select("vec_id", "video_id", "frame_idx", fingerprint.phash_of_coefficients(F.col("coeffs")).alias("phash"))


def order_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = adapted(spark, sf_dir, ITEMS_ORDERS)
    return items.withColumns({"captured_at": F.col("captured_at").cast("timestamp_ntz"), "parent_path": F.col("source_root"), "path": F.concat("source_root", F.lit("/"), F.col("item_id").cast("string"), F.lit("/"), "file_name"), "make": F.lit(None).cast("string")}).withColumn("parent_path", text.parent(F.col("path")))


def path_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = adapted(spark, sf_dir, ITEMS_PATHS)
    return items.withColumns({"file_name": text.file_name(F.col("path")), "parent_path": text.parent(F.col("path")), "file_size": F.col("file_size").cast("long")})


_DOCS = f"WITH base AS ({ITEMS_DOCS}), items AS (SELECT *, concat(parent_path, '/', file_name) AS path, sha256(content) AS identity, CASE time_source WHEN 'exif' THEN 5 WHEN 'container' THEN 4 WHEN 'fileName' THEN 3 WHEN 'fileSystem' THEN 1 ELSE 0 END AS trust FROM base)"
_EXACT = _DOCS + """,
grouped AS (SELECT *, min(item_id) OVER (PARTITION BY identity) AS group_id, count(*) OVER (PARTITION BY identity) AS member_count FROM items),
ranked AS (SELECT *, row_number() OVER (PARTITION BY group_id ORDER BY trust DESC, length(path) - length(replace(path, '/', '')), length(file_name), path, item_id) AS r FROM grouped WHERE member_count > 1)"""


@query(_EXACT + """
SELECT group_id, item_id, CAST(row_number() OVER (PARTITION BY group_id ORDER BY r = 1 DESC, file_size DESC, path, item_id) AS INT) AS member_rank, r = 1 AS is_keep FROM ranked""")
def exact_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = docs_items(spark, sf_dir)
    _, members = dedup.groups_and_members(items, dedup.exact_groups(items))
    return members.select("group_id", "item_id", "member_rank", "is_keep")


@query(_EXACT + """,
two AS (SELECT group_id, any_value(member_count) AS member_count, max(CASE WHEN r = 1 THEN trust END) AS t1, max(CASE WHEN r = 2 THEN trust END) AS t2 FROM ranked GROUP BY group_id)
SELECT group_id, 'exact' AS dup_kind, member_count, CAST(0 AS INT) AS max_distance, CASE WHEN t1 <> t2 THEN 'trustedTimestamp' ELSE (
  SELECT CASE WHEN max(length(path) - length(replace(path, '/', ''))) <> min(length(path) - length(replace(path, '/', ''))) THEN 'shallowestPath' ELSE 'exactDuplicate' END FROM ranked q WHERE q.group_id = two.group_id AND q.r <= 2) END AS keep_reason FROM two""")
def exact_group_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = docs_items(spark, sf_dir)
    groups, _ = dedup.groups_and_members(items, dedup.exact_groups(items))
    return groups.select("group_id", "dup_kind", "member_count", "max_distance", "keep_reason")


@query(_EXACT + """
SELECT group_id, CAST(sum(CASE WHEN r > 1 THEN file_size ELSE 0 END) AS BIGINT) AS reclaimable_bytes, count(*) - 1 AS redundant_files FROM ranked GROUP BY group_id""")
def reclaimable_bytes(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = docs_items(spark, sf_dir)
    _, members = dedup.groups_and_members(items, dedup.exact_groups(items))
    return dedup.reclaimable(dedup.apply_decisions(members)).select("group_id", "reclaimable_bytes", "redundant_files")


@query(_EXACT + """,
decided AS (SELECT *, CASE group_id % 3 WHEN 0 THEN false WHEN 1 THEN true ELSE r > 1 END AS gone FROM ranked)
SELECT count(DISTINCT group_id) AS group_count, count(DISTINCT group_id) AS exact_groups, count(DISTINCT CASE WHEN group_id % 3 = 0 THEN group_id END) AS keep_all_groups, count(DISTINCT CASE WHEN group_id % 3 = 1 THEN group_id END) AS discard_all_groups,
  count(*) FILTER (gone) AS redundant_files, CAST(coalesce(sum(file_size) FILTER (gone), 0) AS BIGINT) AS reclaimable_bytes FROM decided""")
def dedup_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """With decisions on whole groups: kept all, discarded all, by selection."""
    items = docs_items(spark, sf_dir)
    groups, members = dedup.groups_and_members(items, dedup.exact_groups(items))
    choice = F.when(F.col("group_id") % 3 == 0, "keepAll").when(F.col("group_id") % 3 == 1, "discardAll").otherwise("bySelection")
    decided = dedup.apply_decisions(members, dispositions=groups.select("group_id", choice.alias("disposition")))
    return dedup.summary(groups, decided).drop("similar_image_groups", "similar_video_groups")


_PHASH = f"""WITH raw AS ({FRAMES_VEC}), wide AS (SELECT vec_id, video_id, frame_idx, list_transform(coeffs, lambda x: CAST(x AS DOUBLE)) AS c FROM raw),
mid AS (SELECT *, (list_sort(c)[32] + list_sort(c)[33]) / 2 AS m FROM wide),
hashed AS (SELECT vec_id, video_id, frame_idx, list_reduce(list_prepend(CAST(0 AS HUGEINT), list_transform(range(0, 64), lambda i: CASE WHEN c[i + 1] > m THEN CAST(1 AS HUGEINT) << CAST(i AS INT) ELSE CAST(0 AS HUGEINT) END)), lambda a, b: a + b) AS h FROM mid)"""


@query(_PHASH + " SELECT vec_id, printf('%016x', CAST(h AS UBIGINT)) AS phash FROM hashed")
def perceptual_hashes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return frames(spark, sf_dir).select("vec_id", text.phash_hex(F.col("phash")).alias("phash"))


_NEAR = _PHASH + ", links AS (SELECT a.vec_id AS a, b.vec_id AS b, CAST(bit_count(CAST(xor(a.h, b.h) AS HUGEINT)) AS INT) AS distance FROM hashed a JOIN hashed b ON a.vec_id < b.vec_id AND bit_count(CAST(xor(a.h, b.h) AS HUGEINT)) <= 20)"


@query(_NEAR + " SELECT a, b, distance FROM links")
def hamming_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return similarity.all_hamming_pairs(frames(spark, sf_dir), 20, "vec_id")


@query(_NEAR.replace("WITH raw", "WITH RECURSIVE raw") + """,
both_ways AS (SELECT a, b FROM links UNION SELECT b, a FROM links),
reach AS (SELECT a AS node, a AS seen FROM both_ways UNION SELECT reach.node, both_ways.b FROM reach JOIN both_ways ON reach.seen = both_ways.a)
SELECT min(seen) AS group_id, node AS item_id FROM reach GROUP BY node""")
def hamming_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = frames(spark, sf_dir)
    return dedup.clusters(similarity.hamming_joins(rows, 20, "vec_id").unionByName(similarity.equal_hash_links(rows, "vec_id")))


#: Hashes a few bits apart: of every three, the first one's with some bits turned.
_CLOSE = _PHASH.replace("hashed AS", "plain AS") + """,
hashed AS (SELECT a.vec_id, a.video_id, a.frame_idx, xor(b.h, CAST([0, 5, 1099512676360][a.vec_id % 3 + 1] AS HUGEINT)) AS h FROM plain a JOIN plain b ON b.vec_id = a.vec_id - a.vec_id % 3)"""


def close_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = frames(spark, sf_dir)
    base = rows.filter("vec_id % 3 = 0").select(F.col("vec_id").alias("v"), F.col("phash").alias("h"))
    turned = F.element_at(F.array(*[F.lit(x).cast("long") for x in (0, 5, 1099512676360)]), (F.col("vec_id") % 3 + 1).cast("int"))
    return rows.join(base, F.col("vec_id") - F.col("vec_id") % 3 == F.col("v")).select("vec_id", "video_id", "frame_idx", F.col("h").bitwiseXOR(turned).alias("phash"))


_SIMILAR = _PHASH.replace("WITH raw", "WITH RECURSIVE raw") + """,
items AS (SELECT vec_id AS item_id, h, 120000 * (1 + vec_id % 3) * (1 + vec_id % 3) AS pixels, vec_id * 10 AS file_size, concat('/v/', CAST(vec_id AS STRING), '.jpg') AS path FROM hashed),
links AS (SELECT a.item_id AS a, b.item_id AS b, CAST(bit_count(CAST(xor(a.h, b.h) AS HUGEINT)) AS INT) AS distance FROM items a JOIN items b ON a.item_id < b.item_id AND bit_count(CAST(xor(a.h, b.h) AS HUGEINT)) <= {t}),
both_ways AS (SELECT a, b FROM links UNION SELECT b, a FROM links),
reach AS (SELECT a AS node, a AS seen FROM both_ways UNION SELECT reach.node, both_ways.b FROM reach JOIN both_ways ON reach.seen = both_ways.a),
member AS (SELECT min(seen) AS group_id, node AS item_id FROM reach GROUP BY node),
per AS (SELECT group_id, count(*) AS member_count, count(DISTINCT h) AS identities FROM member JOIN items USING (item_id) GROUP BY group_id),
far AS (SELECT group_id, max(distance) AS most FROM links JOIN member ON a = item_id GROUP BY group_id),
ranked AS (SELECT *, row_number() OVER (PARTITION BY group_id ORDER BY pixels DESC, file_size DESC) AS r FROM member JOIN items USING (item_id)),
best AS (SELECT group_id, h AS best_hash, pixels AS best_pixels FROM ranked WHERE r = 1),
rival AS (SELECT group_id, min_by(pixels, r) AS rival_pixels FROM ranked JOIN best USING (group_id) WHERE h <> best_hash GROUP BY group_id)
SELECT group_id, CASE WHEN identities = 1 THEN 'exact' ELSE 'similarImage' END AS dup_kind, member_count, CAST(CASE WHEN identities = 1 THEN 0 ELSE most END AS INT) AS max_distance,
  CASE WHEN identities = 1 THEN 'exactDuplicate' WHEN best_pixels <> rival_pixels THEN 'highestResolution' ELSE 'largestFile' END AS keep_reason
FROM per JOIN far USING (group_id) JOIN best USING (group_id) LEFT JOIN rival USING (group_id)"""


def _similar(hashed: DataFrame, threshold: int) -> DataFrame:
    rows = hashed.select(F.col("vec_id").alias("item_id"), "phash", "frame_idx", "video_id")
    items = rows.withColumns({"kind": F.lit("image"), "width": (F.lit(400) * (1 + F.col("item_id") % 3)).cast("int"), "height": (F.lit(300) * (1 + F.col("item_id") % 3)).cast("int"), "color_sig": F.lit(None).cast("array<short>"), "time_source": F.lit("exif"), "file_size": F.col("item_id") * 10, "path": F.concat(F.lit("/v/"), F.col("item_id").cast("string"), F.lit(".jpg")), "identity": F.concat(F.lit("h:"), F.col("phash").cast("string"))})
    return dedup.recluster(items, threshold)[0]


@query(_SIMILAR.replace("{t}", "20"))
def similar_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Images with perceptual hashes in one graph of exact and near links."""
    return _similar(frames(spark, sf_dir), 20)


@query(_SIMILAR.replace("{t}", "6").replace(_PHASH.replace("WITH raw", "WITH RECURSIVE raw"), _CLOSE.replace("WITH raw", "WITH RECURSIVE raw")))
def similar_groups_default(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As `similar_groups` with the usual threshold, over hashes a few bits apart."""
    return _similar(close_frames(spark, sf_dir), 6)


@query(_NEAR.replace("<= 20", "<= 8").replace(_PHASH, _CLOSE) + " SELECT a, b, distance FROM links")
def hamming_join_by_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """At the largest threshold that is joined by chunks."""
    return similarity.all_hamming_pairs(close_frames(spark, sf_dir), 8, "vec_id")


_SEQ = _PHASH + ", seqs AS (SELECT video_id, list(h ORDER BY frame_idx) AS f FROM hashed GROUP BY video_id), d AS (SELECT a.video_id AS a, b.video_id AS b, list_transform(range(1, least(len(a.f), len(b.f)) + 1), lambda i: bit_count(CAST(xor(a.f[i], b.f[i]) AS HUGEINT))) AS ds, greatest(len(a.f), len(b.f)) AS n FROM seqs a JOIN seqs b ON b.video_id = a.video_id + 1)"


@query(_SEQ + " SELECT a, b, CAST(len(list_filter(ds, lambda x: x <= 28)) AS DOUBLE) / n AS ratio, CAST(list_sum(ds) AS DOUBLE) / len(ds) AS mean FROM d")
def frame_agreements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Agreement of each sequence with the next one."""
    seqs = frames(spark, sf_dir).groupBy("video_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("frame_idx", "phash"))), lambda x: x["phash"]).alias("f"))
    pairs = seqs.toDF("a", "fa").join(seqs.toDF("b", "fb"), F.col("b") == F.col("a") + 1)
    return pairs.select("a", "b", F.inline(F.array(fingerprint.frame_agreement(F.col("fa"), F.col("fb"), 28))))


_VIDEO = _PHASH + """,
videos AS (SELECT vec_id AS item_id, list_transform([0, 5, 9, 33, 1048577], lambda x: xor(h, CAST(x AS HUGEINT))) AS f, CAST(60 + vec_id % 4 * 5 AS DOUBLE) AS d FROM hashed),
pairs AS (SELECT a.item_id AS a, b.item_id AS b, list_transform(range(1, 6), lambda i: CAST(bit_count(CAST(xor(a.f[i], b.f[i]) AS HUGEINT)) AS INT)) AS ds FROM videos a JOIN videos b ON a.item_id < b.item_id AND abs(a.d - b.d) / greatest(a.d, b.d) <= 0.15
  AND len(list_filter(range(0, 64, {bits}), lambda s: (a.f[1] >> CAST(s AS HUGEINT)) % (1 << {bits}) = (b.f[1] >> CAST(s AS HUGEINT)) % (1 << {bits}))) > 0)
SELECT a, b, CAST(round(list_sum(ds) / 5.0) AS INT) AS distance FROM pairs WHERE len(list_filter(ds, lambda x: x <= {t})) / 5.0 >= 0.6"""


def _videos(hashed: DataFrame) -> DataFrame:
    """Each hash as a video of five frames, some bits apart."""
    made = F.transform(F.array(*[F.lit(x).cast("long") for x in (0, 5, 9, 33, 1048577)]), lambda x: F.col("phash").bitwiseXOR(x))
    return hashed.select(F.col("vec_id").alias("item_id"), made.alias("frames"), (60 + F.col("vec_id") % 4 * 5).cast("double").alias("duration"))


@query(_VIDEO.replace("{t}", "20").replace("{bits}", "3"))
def video_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Videos whose first frames share a chunk, of like lengths, that agree in three frames of five."""
    return similarity.video_links(_videos(frames(spark, sf_dir)), 20, all_copies=True)


@query(_VIDEO.replace("{t}", "6").replace("{bits}", "9").replace(_PHASH, _CLOSE))
def video_groups_default(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As `video_groups` with the usual threshold."""
    return similarity.video_links(_videos(close_frames(spark, sf_dir)), 6, all_copies=True)


@query(_DOCS + """
SELECT item_id, CASE WHEN make IS NOT NULL AND model IS NOT NULL THEN CASE WHEN starts_with(lower(model), lower(make)) THEN model ELSE concat(make, ' ', model) END ELSE coalesce(model, make, '未知设备') END AS device,
  concat(width, '×', height) AS resolution, length(path) - length(replace(path, '/', '')) AS depth, regexp_extract(file_name, '^.+\\.([^./]+)$', 1) AS ext, regexp_replace(file_name, '\\.[^./]+$', '') AS stem, substr(identity, 1, 8) AS hash8 FROM items""")
def labels_and_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = docs_items(spark, sf_dir)
    return items.select("item_id", text.camera_label(F.col("make"), F.col("model")).alias("device"), text.resolution_label(F.col("width"), F.col("height")).alias("resolution"), text.path_depth(F.col("path")).cast("long").alias("depth"), text.extension(F.col("file_name")).alias("ext"), text.stem(F.col("file_name")).alias("stem"), text.short_hash(F.substring("identity", 5, 64), F.lit(None).cast("string"), F.lit(None).cast("long"), F.col("item_id")).alias("hash8"))


@query(_DOCS + rf""",
parts AS (SELECT item_id, regexp_extract(file_name, '{capture.NAME_PATTERN}', ['y','mo','d','h','mi','s']) AS p FROM items)
SELECT item_id, CASE WHEN p.y <> '' THEN strftime(try_cast(concat(p.y, '-', p.mo, '-', p.d, ' ', p.h, ':', p.mi, ':', p.s) AS TIMESTAMP), '%Y-%m-%d %H:%M:%S') END AS captured FROM parts""")
def capture_from_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    return docs_items(spark, sf_dir).select("item_id", text.captured_label(F.col("captured_at")).alias("captured"))


_ORD = f"WITH base AS ({ITEMS_ORDERS}), items AS (SELECT *, concat(source_root, '/', CAST(item_id AS STRING), '/', file_name) AS path FROM base)"
_DIRS = """, dirs AS (SELECT *, CASE WHEN captured_at IS NULL THEN '/out/未识别日期' ELSE concat('/out/', strftime(captured_at, '%Y/%m/%m-%d')) END AS target_dir FROM items)"""


@query(_ORD + _DIRS + """
SELECT item_id, CAST(row_number() OVER (PARTITION BY target_dir ORDER BY captured_at NULLS LAST, file_name, path) AS INT) AS seq FROM dirs""")
def sequence_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    rule = organise.Rule(rename_template="{yyyyMMdd}_{seq}")
    rows = organise.considered(order_items(spark, sf_dir), organise.Filter())
    return organise.prepared(rows, rule, organise.Filter()).select("item_id", "seq")


@query(_ORD + """
SELECT item_id, coalesce(strftime(captured_at, '%Y/%m/%m-%d'), '未识别日期/未识别日期/未识别日期') || '/' || model AS by_device, coalesce(strftime(captured_at, '%Y-%m-%d_%H-%M-%S'), '未识别日期') || '_ord' || CAST(item_id % 5 AS STRING) AS renamed,
  coalesce(strftime(captured_at, '%Y%m%d'), '未识别日期') || '_0007' AS numbered, '{nope}' || substr(source_root, 6) AS odd FROM items""")
def rendered_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = order_items(spark, sf_dir)
    names = templates.variables(templates.Fields.of(items.columns, F.lit(7)))
    return items.select("item_id", templates.render_folder(templates.FOLDER_PRESETS[0], names).alias("by_device"), templates.render_file_name(templates.RENAME_PRESETS[1], names).alias("renamed"), templates.render_file_name(templates.RENAME_PRESETS[5], names).alias("numbered"), templates.render("{nope}{sourceFolder}", names).alias("odd"))


_SKIP = _ORD + _DIRS + """,
inventory AS (SELECT DISTINCT concat(target_dir, '/', file_name) AS path FROM dirs WHERE item_id % 7 = 0 AND captured_at IS NOT NULL),
placed AS (SELECT dirs.*, concat(target_dir, '/', dirs.file_name) AS desired, inventory.path IS NOT NULL AS on_disk, row_number() OVER (PARTITION BY target_dir, dirs.file_name ORDER BY scan_ordinal) AS turn FROM dirs LEFT JOIN inventory ON inventory.path = concat(target_dir, '/', dirs.file_name)),
ops AS (SELECT item_id, desired, target_dir, file_size, CASE WHEN on_disk OR turn > 1 THEN 'skipped' ELSE 'move' END AS op_kind FROM placed)"""


def _inventory(items: DataFrame, rule: organise.Rule) -> DataFrame:
    """Files already at the destination: rendered paths of every seventh dated item."""
    rows = organise.considered(items.filter("item_id % 7 = 0 AND captured_at IS NOT NULL"), organise.Filter())
    return organise.prepared(rows, rule, organise.Filter()).select(F.col("desired").alias("path")).distinct()


def _plan(spark: SparkSession, sf_dir: str, conflict: str) -> tuple[DataFrame, DataFrame, organise.Rule]:
    items, rule = order_items(spark, sf_dir), organise.Rule(conflict=conflict)
    rows = organise.considered(items, organise.Filter())
    return rows, organise.build(rows, rule, organise.Filter(), _inventory(items, rule)), rule


@query(_SKIP + " SELECT item_id, op_kind, desired AS destination_path FROM ops")
def plan_skip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _plan(spark, sf_dir, "skip")[1].select("item_id", "op_kind", "destination_path")


@query(_SKIP + """
SELECT CAST(count(*) FILTER (op_kind = 'move') AS BIGINT) AS move_count, CAST(coalesce(sum(file_size) FILTER (op_kind = 'move'), 0) AS BIGINT) AS move_bytes, count(*) FILTER (op_kind = 'skipped') AS skipped_count, CAST(0 AS BIGINT) AS already_placed_count FROM ops""")
def plan_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return organise.transfer_summary(_plan(spark, sf_dir, "skip")[1]).select("move_count", "move_bytes", "skipped_count", "already_placed_count")


@query(_SKIP + " SELECT target_dir, count(*) AS n FROM ops WHERE op_kind = 'move' GROUP BY target_dir")
def plan_folder_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return organise.folder_counts(_plan(spark, sf_dir, "skip")[1])


@query(_SKIP + " SELECT substr(target_dir, 6) AS folder, count(*) AS n FROM ops WHERE op_kind = 'move' GROUP BY 1 ORDER BY 1 LIMIT 24")
def plan_folder_preview(spark: SparkSession, sf_dir: str) -> DataFrame:
    return organise.folder_preview(_plan(spark, sf_dir, "skip")[1], "/out")


_WHY = "CASE WHEN captured_at IS NULL THEN '拍摄时间未识别' ELSE concat('拍摄时间 ', strftime(captured_at, '%Y-%m-%d %H:%M:%S'), '（来源：', time_source, '）') END"
_NUMBER = "concat(target_dir, '/', regexp_replace(file_name, '\\.jpg$', ''), '_', CAST({n} AS STRING), '.jpg')"


@query(_SKIP + f"""
SELECT item_id, 'move' AS op_kind, CASE WHEN on_disk THEN {_NUMBER.format(n='turn')} WHEN turn > 1 THEN {_NUMBER.format(n='turn - 1')} ELSE desired END AS destination_path,
  concat({_WHY}, CASE WHEN on_disk THEN ' · （目标已存在，自动加序号）' WHEN turn > 1 THEN ' · （与本次计划内其他文件重名，自动加序号）' ELSE '' END) AS reason FROM placed""")
def plan_auto_number(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _plan(spark, sf_dir, "autoNumber")[1].select("item_id", "op_kind", "destination_path", "reason")


@query(_SKIP + f"""
SELECT item_id, 'move' AS op_kind, CASE WHEN turn > 1 THEN {_NUMBER.format(n='turn - 1')} ELSE desired END AS destination_path, on_disk AND turn = 1 AS overwrites_existing FROM placed""")
def plan_overwrite(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _plan(spark, sf_dir, "overwrite")[1].select("item_id", "op_kind", "destination_path", "overwrites_existing")


@query(_SKIP + f""",
taken AS (SELECT DISTINCT target_dir, file_name, 1 + item_id % 4 AS number FROM dirs WHERE item_id % 11 = 0 AND captured_at IS NOT NULL),
wanting AS (SELECT *, row_number() OVER (PARTITION BY target_dir, file_name ORDER BY scan_ordinal) AS t FROM placed WHERE on_disk OR turn > 1),
most AS (SELECT target_dir, file_name, max(t) AS t FROM wanting GROUP BY target_dir, file_name),
listed AS (SELECT target_dir, file_name, unnest(range(1, t + 5)) AS number FROM most),
free AS (SELECT *, row_number() OVER (PARTITION BY target_dir, file_name ORDER BY number) AS t FROM listed ANTI JOIN taken USING (target_dir, file_name, number)),
given AS (SELECT item_id, number FROM wanting JOIN free USING (target_dir, file_name, t))
SELECT item_id, CASE WHEN number IS NULL THEN desired ELSE {_NUMBER.format(n='number')} END AS destination_path FROM placed LEFT JOIN given USING (item_id)""")
def plan_number_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numbers beside files that have some of them already."""
    items, rule, f = order_items(spark, sf_dir), organise.Rule(conflict="autoNumber"), organise.Filter()
    rows = organise.considered(items, f)
    more = organise.prepared(rows.filter("item_id % 11 = 0 AND captured_at IS NOT NULL"), rule, f).select(F.concat("target_dir", F.lit("/"), text.stem(F.col("file_name")), F.lit("_"), (1 + F.col("item_id") % 4).cast("string"), F.lit(".jpg")).alias("path"))
    return organise.build(rows, rule, f, _inventory(items, rule).unionByName(more)).select("item_id", "destination_path")


@query(_SKIP + """
SELECT * FROM (
  SELECT 'unknown_time' AS code, count(*) FILTER (captured_at IS NULL OR time_source = 'none') AS n, CAST(0 AS BIGINT) AS bytes FROM items
  UNION ALL SELECT 'filesystem_time', count(*) FILTER (time_source = 'fileSystem'), 0 FROM items
  UNION ALL SELECT 'moves', count(*), CAST(coalesce(sum(file_size), 0) AS BIGINT) FROM ops WHERE op_kind = 'move') WHERE n > 0""")
def plan_warnings(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, operations, rule = _plan(spark, sf_dir, "skip")
    return organise.warnings(rows, operations, rule, organise.Filter())


@query(_ORD + """
SELECT count(*) AS considered, count(*) FILTER (NOT ok) AS filtered_out, CAST(0 AS BIGINT) AS excluded FROM (
  SELECT coalesce(captured_at >= TIMESTAMP '1994-01-01' AND captured_at <= TIMESTAMP '1996-12-31', false) AND time_source IN ('exif', 'container', 'fileName') AND model IN ('BUILDING', 'MACHINERY') AS ok FROM items)""")
def plan_filter_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = organise.Filter(date_from="1994-01-01", date_to="1996-12-31", minimum_confidence=3, devices=("BUILDING", "MACHINERY"))
    return organise.counters(organise.considered(order_items(spark, sf_dir), f))


_KEPT = _EXACT + """,
decided AS (SELECT *, group_id % 3 = 1 AND item_id % 2 = 0 OR r = 1 AS kept, row_number() OVER (PARTITION BY group_id ORDER BY r = 1 DESC, file_size DESC, path, item_id) AS member_rank FROM ranked),
names AS (SELECT group_id, concat(min_by(file_name, member_rank), CASE WHEN count(*) > 1 THEN concat(' 等 ', CAST(count(*) AS STRING), ' 份') ELSE '' END) AS keep_name FROM decided WHERE kept GROUP BY group_id)"""


def _decided(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Items, groups, and members with some more kept ones."""
    items = docs_items(spark, sf_dir)
    groups, members = dedup.groups_and_members(items, dedup.exact_groups(items))
    more = members.filter("group_id % 3 = 1 AND item_id % 2 = 0").select("group_id", "item_id", F.lit(True).alias("keep"))
    return items, groups, dedup.apply_decisions(members, more)


@query(_KEPT + " SELECT item_id, 'trash' AS op_kind, concat('完全重复冗余副本 · 同组保留「', keep_name, '」') AS reason FROM decided JOIN names USING (group_id) WHERE NOT kept")
def plan_clean_only(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Only the trash operations of redundant copies."""
    items, groups, decided = _decided(spark, sf_dir)
    redundant = decided.filter("is_redundant").join(organise.kept_names(decided), "group_id", "left").join(groups.select("group_id", "dup_kind"), "group_id")
    rule, f = organise.Rule(), organise.Filter(archive_files=False)
    rows = organise.considered(items, f, redundant)
    return organise.build(rows, rule, f, items.select("path").limit(0)).select("item_id", "op_kind", "reason")


@query(_ORD + """
SELECT count(*) FILTER (kind = 'image') AS images, count(*) FILTER (kind = 'video') AS videos, CAST(sum(file_size) AS BIGINT) AS bytes, count(*) FILTER (captured_at IS NULL OR time_source = 'none') AS unknown_time, count(*) FILTER (time_source = 'fileSystem') AS filesystem_time FROM items""")
def catalogue_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.totals(order_items(spark, sf_dir))


@query(_ORD + " SELECT CAST(year(captured_at) AS INT) AS year, count(*) AS n FROM items WHERE captured_at IS NOT NULL GROUP BY 1")
def year_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.year_histogram(order_items(spark, sf_dir))


@query(_ORD + " SELECT model AS device, count(*) AS n FROM items GROUP BY 1 ORDER BY n DESC, device LIMIT 8")
def device_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.device_histogram(order_items(spark, sf_dir))


@query(_ORD + " SELECT item_id FROM items ORDER BY captured_at DESC NULLS LAST, file_name, path LIMIT 200")
def newest_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.sort(order_items(spark, sf_dir), "capturedDesc").limit(200).select("item_id")


@query(_DOCS + " SELECT item_id FROM items WHERE contains(lower(file_name), 'pixel') OR contains(lower(parent_path), 'pixel') OR contains(lower(CASE WHEN make IS NOT NULL AND model IS NOT NULL AND NOT starts_with(lower(model), lower(make)) THEN concat(make, ' ', model) ELSE coalesce(model, make, '未知设备') END), 'pixel')")
def catalogue_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.search(docs_items(spark, sf_dir), " Pixel ").select("item_id")


_TREE = f"""WITH base AS ({ITEMS_PATHS}), items AS (SELECT *, regexp_replace(path, '/[^/]*$', '') AS parent_path FROM base),
spread AS (SELECT source_root, parent_path, file_size, array_to_string(string_split(parent_path, '/')[1:i], '/') AS path FROM (SELECT *, unnest(range(2, len(string_split(parent_path, '/')) + 1)) AS i FROM items)),
folders AS (SELECT source_root, path, CAST(sum(CASE WHEN path = parent_path THEN 1 ELSE 0 END) AS BIGINT) AS file_count, CAST(sum(CASE WHEN path = parent_path THEN file_size ELSE 0 END) AS BIGINT) AS bytes, count(*) AS total_file_count, CAST(sum(file_size) AS BIGINT) AS total_bytes FROM spread GROUP BY 1, 2)"""
_MARKS = "SELECT DISTINCT '/web/' || split_part(substr(path, 6), '/', 1) AS x FROM items WHERE item_id % 40 = 0"


def _marks(items: DataFrame) -> DataFrame:
    return items.filter("item_id % 40 = 0").select(F.concat(F.lit("/web/"), F.split_part(F.substring("path", 6, 10000), F.lit("/"), F.lit(1))).alias("path")).distinct()


@query(_TREE + f", marks AS ({_MARKS}) SELECT path, file_count, bytes, total_file_count, total_bytes, path IN (SELECT x FROM marks) AS is_excluded, EXISTS (SELECT 1 FROM marks WHERE starts_with(path, x || '/')) AS is_inherited FROM folders")
def folder_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = path_items(spark, sf_dir)
    return views.folder_tree(items, _marks(items)).select("path", "file_count", "bytes", "total_file_count", "total_bytes", "is_excluded", "is_inherited")


@query(_TREE + ", kids AS (SELECT regexp_replace(path, '/[^/]*$', '') AS path, count(*) AS children FROM folders WHERE path <> '/web' GROUP BY 1) SELECT folders.path, coalesce(children, 0) AS children FROM folders LEFT JOIN kids USING (path)")
def folder_children(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.child_counts(views.folder_tree(path_items(spark, sf_dir))).select("path", "children")


@query(_TREE + f", marks AS ({_MARKS}) SELECT path FROM folders WHERE NOT EXISTS (SELECT 1 FROM marks WHERE starts_with(folders.path, x || '/'))")
def visible_folders(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = path_items(spark, sf_dir)
    return views.visible_folders(views.folder_tree(items), _marks(items)).select("path")


@query(_TREE + f", marks AS ({_MARKS}) SELECT count(*) AS files, CAST(sum(file_size) AS BIGINT) AS bytes, CAST(count(*) FILTER (EXISTS (SELECT 1 FROM marks WHERE parent_path = x OR starts_with(parent_path, x || '/'))) AS BIGINT) AS excluded_files FROM items")
def root_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = path_items(spark, sf_dir)
    return views.root_totals(items, _marks(items)).select("files", "bytes", "excluded_files")


@query(_TREE + f", marks AS ({_MARKS}) SELECT item_id FROM items WHERE NOT EXISTS (SELECT 1 FROM marks WHERE path = x OR starts_with(path, x || '/')) AND item_id IN (SELECT min(item_id) FROM items GROUP BY path)")
def scan_without_excluded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first item of each path outside the excluded folders."""
    items = path_items(spark, sf_dir)
    kept = catalogue.without_excluded(items, _marks(items))
    return kept.groupBy("path").agg(F.min("item_id").alias("item_id")).select("item_id")


_JOURNAL = f"WITH j AS ({JOURNAL_EVENTS})"


@query(_JOURNAL + """
SELECT session_id, strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS started, strftime(max(ts), '%Y-%m-%d %H:%M:%S') AS finished, count(*) AS entries, count(*) FILTER (result = 'success') AS success_count, count(*) FILTER (result = 'failed') AS failed_count, count(*) FILTER (undone) AS undone_count,
  CAST(coalesce(sum(file_size) FILTER (result = 'success' AND op_kind = 'trash' AND NOT undone), 0) AS BIGINT) AS reclaimed_bytes, bool_or(result = 'success' AND NOT undone) AS can_undo FROM j GROUP BY session_id""")
def journal_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = journal.sessions(adapted(spark, sf_dir, JOURNAL_EVENTS))
    return rows.withColumns({c: F.date_format(c, "yyyy-MM-dd HH:mm:ss") for c in ("started", "finished")})


@query(_JOURNAL + """, n AS (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY seq) - 1 AS place FROM j),
l AS (SELECT *, CASE WHEN result = 'success' AND seq % 13 = 0 THEN 'skipped' ELSE result END AS outcome, row_number() OVER (PARTITION BY session_id, (place - place % 2) ORDER BY seq DESC) AS r FROM n)
SELECT count(*) FILTER (outcome = 'success') AS succeeded, count(*) FILTER (outcome = 'failed') AS failed, count(*) FILTER (outcome = 'skipped') AS skipped, CAST(coalesce(sum(file_size) FILTER (outcome = 'success' AND op_kind = 'trash'), 0) AS BIGINT) AS reclaimed_bytes,
  (SELECT string_agg(concat(regexp_extract(source_path, '([^/]*)$', 1), '：', source_path), ',' ORDER BY seq) FROM (SELECT source_path, seq FROM l WHERE r = 1 AND outcome = 'failed' ORDER BY seq LIMIT 12)) AS messages FROM l WHERE r = 1""")
def execution_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two entries in a row of a session are of one operation, whose result is that of the second."""
    rows = adapted(spark, sf_dir, JOURNAL_EVENTS)
    place = F.row_number().over(Window.partitionBy("session_id").orderBy("seq")) - 1
    rows = rows.withColumns({"place": place, "result": F.when((F.col("result") == "success") & (F.col("seq") % 13 == 0), "skipped").otherwise(F.col("result")), "message": F.col("source_path")})
    rows = rows.withColumn("op_id", F.struct("session_id", (F.col("place") - F.col("place") % 2).alias("pair")))
    return execute.execution_report(rows).select("succeeded", "failed", "skipped", "reclaimed_bytes", F.array_join("messages", ",").alias("messages"))


def _undo_inputs(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    rows = adapted(spark, sf_dir, JOURNAL_EVENTS)
    rows = rows.withColumns({"destination_path": F.when(F.col("op_kind") != "trash", F.concat("source_path", F.lit("_new"))), "trash_path": F.when((F.col("op_kind") == "trash") & (F.col("seq") % 4 > 0), F.concat(F.lit("/.trash"), "source_path"))})
    here = F.coalesce("destination_path", "trash_path")
    files = rows.filter("seq % 9 > 0").select(here.alias("path")).filter("path IS NOT NULL").unionByName(rows.filter("seq % 11 = 0").select(F.col("source_path").alias("path")))
    return rows, files


@query(_JOURNAL + """, s AS (SELECT *, op_kind = 'copy' AS is_copy, CASE WHEN op_kind = 'trash' THEN seq % 4 > 0 ELSE true END AND seq % 9 > 0 AS present, seq % 11 = 0 AS occupied FROM j WHERE result = 'success' AND NOT undone),
t AS (SELECT *, is_copy OR (present AND NOT (op_kind = 'trash' AND occupied)) AS ok FROM s)
SELECT session_id, count(*) FILTER (ok AND NOT is_copy) AS restored, count(*) FILTER (is_copy AND present) AS removed_copies, count(*) FILTER (NOT ok) AS failed FROM t GROUP BY session_id""")
def undo_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return execute.undo_report(execute.undo_plan(*_undo_inputs(spark, sf_dir)))


@query(_SKIP + """
SELECT item_id, CASE WHEN op_kind = 'move' THEN desired ELSE path END AS path FROM ops JOIN items USING (item_id)""")
def catalogue_after_apply(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The catalogue once the plan with policy `skip` has been applied."""
    items = order_items(spark, sf_dir)
    _, operations, rule = _plan(spark, sf_dir, "skip")
    files = items.select("path").unionByName(_inventory(items, rule))
    return execute.after_apply(items, execute.apply_plan(operations, files, "s1")).select("item_id", "path")


@query(f"""WITH base AS ({ITEMS_PATHS}), items AS (SELECT DISTINCT ON (path) path, CAST(file_size AS BIGINT) AS file_size FROM base ORDER BY path, item_id)
SELECT path, file_size % 3 > 0 AND file_size % 4 < 2 AS is_hit FROM items""")
def cache_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items whose cached size and time are the present ones; every third size is outdated, times are up to three seconds off."""
    items = path_items(spark, sf_dir).groupBy("path").agg(F.min_by("file_size", "item_id").alias("file_size"))
    items = items.withColumn("file_modified", F.timestamp_seconds(F.col("file_size")))
    cache = items.withColumns({"file_modified": F.timestamp_seconds(F.col("file_size") + F.col("file_size") % 4), "file_size": F.when(F.col("file_size") % 3 == 0, F.col("file_size") + 1).otherwise(F.col("file_size")), "phash": F.xxhash64("path")})
    return catalogue.cache_lookup(items, cache).select("path", "is_hit")


@query(_DOCS + " SELECT item_id, trust AS time_confidence FROM items")
def time_confidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return docs_items(spark, sf_dir).select("item_id", confidence(F.col("time_source")).alias("time_confidence"))


@query(_EXACT + """, picked AS (SELECT item_id, file_size FROM items WHERE item_id % 2 = 0), per AS (SELECT group_id, count(*) AS m, count(picked.item_id) AS k, count(*) FILTER (r = 1 AND picked.item_id IS NOT NULL) AS keepers FROM ranked LEFT JOIN picked USING (item_id) GROUP BY group_id)
SELECT 'picked' AS code, count(*) AS n, CAST(coalesce(sum(file_size), 0) AS BIGINT) AS bytes FROM picked UNION ALL SELECT 'whole_groups', count(*) FILTER (m = k), 0 FROM per UNION ALL SELECT 'whole_group_members', CAST(coalesce(sum(m) FILTER (m = k), 0) AS BIGINT), 0 FROM per UNION ALL SELECT 'picked_keepers', CAST(sum(keepers) AS BIGINT), 0 FROM per""")
def cleanup_warnings(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = docs_items(spark, sf_dir)
    _, members = dedup.groups_and_members(items, dedup.exact_groups(items))
    return organise.trash_only_warnings(members, items.filter("item_id % 2 = 0"))
