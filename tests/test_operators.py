import random

import pytest
from pyspark.sql import functions as F

from shutterloom.operators import components, dedup, similarity, views
from shutterloom.scratch import checkpointed


def test_components_against_union_find(spark):
    rng = random.Random(3)
    edges = [(rng.randrange(200), rng.randrange(200)) for _ in range(150)] + [(500, 500), (7, None)]
    up = {}

    def find(x):
        up.setdefault(x, x)
        while up[x] != x:
            x = up[x]
        return x

    for a, b in edges:
        if b is not None:
            a, b = find(a), find(b)
            up[max(a, b)] = min(a, b)
    want = {x: find(x) for x in up}
    got = {r.node: r.component for r in components.connected_components(spark.createDataFrame(edges, "src long, dst long")).collect()}
    assert got == {k: v for k, v in want.items() if k in got} and set(got) >= {x for e in edges if e[1] is not None for x in e}
    assert components.connected_components(spark.createDataFrame([], "src long, dst long")).count() == 0


@pytest.mark.parametrize("few", [True, False])
def test_components_of_few_edges_take_few_tasks(spark, few, monkeypatch):
    if not few:
        monkeypatch.setattr(components, "FEW_EDGES", 0)
    edges = spark.createDataFrame([(i * 7 % 307, (i + 1) * 7 % 307) for i in range(306)] + [(900, 901), (5000, 5000), (7, 7)], "src long, dst long").coalesce(1)
    context, held = spark.sparkContext, {k: spark.conf.get(k, None) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled", "spark.sql.autoBroadcastJoinThreshold")}
    for k, v in zip(held, ("37", "false", "-1"), strict=True):
        spark.conf.set(k, v)
    try:
        context.setJobGroup(f"components {few}", "")
        got = {r.node: r.component for r in components.connected_components(edges).collect()}
        told = context.statusTracker()
        stages = {s for j in told.getJobIdsForGroup(f"components {few}") for s in told.getJobInfo(j).stageIds}
        tasks = sum(told.getStageInfo(s).numCompletedTasks for s in stages if told.getStageInfo(s))
    finally:
        context.setLocalProperty("spark.jobGroup.id", None)
        for k, v in held.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    assert got == {i: 0 for i in range(307)} | {900: 900, 901: 900, 5000: 5000}
    # a round with its shuffles has some 200
    assert not few or tasks < 300


@pytest.mark.parametrize("threshold", [0, 3, 6, 8, 12, 20])
def test_hamming_pairs_against_brute_force(spark, threshold):
    rng = random.Random(threshold)
    base = [rng.getrandbits(64) for _ in range(20)]
    values = base + [b ^ sum(1 << i for i in rng.sample(range(64), rng.randint(1, 22))) for b in base for _ in range(4)] + base[:2]
    signed = [v - (1 << 64) if v >> 63 else v for v in values]
    df = spark.createDataFrame([*enumerate(signed), (999, None)], "item_id long, phash long")
    distinct = {}
    for i, v in enumerate(values):
        distinct.setdefault(v, i)
    want = {(min(a, b), max(a, b), (x ^ y).bit_count()) for x, a in distinct.items() for y, b in distinct.items() if a < b and (x ^ y).bit_count() <= threshold}
    assert {tuple(r) for r in similarity.hamming_pairs(df, threshold).collect()} == want
    assert similarity.equal_hash_links(df).count() == len(values) - len(distinct)


def test_colour_trap(spark):
    """Equal hashes with other colours aren't linked; missing colours are compatible."""
    h = 0x966969940596F769 - (1 << 64)
    rows = [(1, h, 10, 10, [30, 180, 60] * 16), (2, h, 10, 10, [240, 240, 240] * 16), (3, h, 10, 10, None)]
    df = spark.createDataFrame(rows, "item_id long, phash long, width int, height int, color_sig array<short>")
    assert {(r.a, r.b) for r in similarity.image_links(df).collect()} == {(1, 3), (2, 3)}


def test_videos(spark):
    rows = [(1, [1, 2, 3, 4, 5], None), (2, [1, 2, 3, -1, -2], None), (3, [1, 2], None), (4, [], None), (5, [1, 2, 3, 4, 5], 9.0), (6, [1, 2, 3, 4, 5], 20.0)]
    df = spark.createDataFrame(rows, "item_id long, frames array<long>, duration double")
    got = {(r.a, r.b) for r in similarity.video_links(df).collect()}
    assert (1, 2) in got and (1, 5) in got and (5, 6) not in got and not any(x in (3, 4) for p in got for x in p)


ITEM = "item_id string, path string, kind string, time_source string, file_size long, width int, height int, identity string"


@pytest.fixture(scope="module")
def members(spark):
    rows = [
        ("A", "/l/A_original.jpg", "image", "exif", 900, 1200, 800, "sha:1"),
        ("B", "/l/A_exact_copy.jpg", "image", "exif", 900, 1200, 800, "sha:1"),
        ("C", "/l/A_resized.jpg", "image", "exif", 200, 600, 400, "sha:2"),
        ("D", "/l/B_original.jpg", "image", "exif", 50, 800, 600, "sha:3"),
        ("E", "/l/x/B_copy.jpg", "image", "exif", 50, 800, 600, "sha:3"),
    ]
    items = spark.createDataFrame(rows, ITEM)
    links = dedup.identity_links(items).unionByName(spark.createDataFrame([("A", "C", 2)], "a string, b string, distance int"))
    return (items, *dedup.groups_and_members(items, dedup.clusters(links), links))


def test_groups(members):
    _, groups, rows = members
    got = {r.group_id: (r.dup_kind, r.member_count, r.max_distance, r.keep_reason) for r in groups.collect()}
    assert got == {"A": ("similarImage", 3, 2, "highestResolution"), "D": ("exact", 2, 0, "shallowestPath")}
    assert {r.item_id for r in rows.filter("is_keep").collect()} == {"A", "D"}


def test_decisions(spark, members):
    _, groups, rows = members
    none = spark.createDataFrame([("A", i, False) for i in "ABC"], "group_id string, item_id string, keep boolean")
    kept = dedup.apply_decisions(rows, none).filter("group_id = 'A' AND NOT is_redundant").collect()
    assert [r.member_rank for r in kept] == [1]
    both = spark.createDataFrame([("A", "C", True)], "group_id string, item_id string, keep boolean")
    assert dedup.apply_decisions(rows, both).filter("group_id = 'A' AND is_redundant").count() == 1
    way = lambda d: dedup.apply_decisions(rows, dispositions=spark.createDataFrame([("A", d)], "group_id string, disposition string")).filter("group_id = 'A' AND is_redundant").count()
    assert (way("keepAll"), way("bySelection"), way("discardAll")) == (0, 2, 3)
    decided = dedup.apply_decisions(rows)
    s = dedup.summary(groups, decided).first()
    assert (s.group_count, s.redundant_files, s.reclaimable_bytes) == (2, 3, 900 + 200 + 50)


def test_prune(spark, members):
    _, groups, rows = members
    groups, left = dedup.prune(groups, rows, spark.createDataFrame([("A",), ("C",), ("D",)], "item_id string"))
    assert [r.group_id for r in groups.collect()] == ["A"] and left.filter("is_keep").count() == 1


def test_two_level_hashes(spark):
    items = spark.createDataFrame([(1, "q"), (2, "q"), (3, "z"), (4, None)], "item_id long, quick_signature string")
    contents = spark.createDataFrame([(i, "same" if i < 3 else "x") for i in (1, 2, 3, 4)], "item_id long, content string")
    got = {r.item_id: r.content_hash for r in dedup.confirmed_hashes(items, contents).collect()}
    assert got[1] == got[2] is not None and got[3] is None and got[4] is None


def test_exclusion_borders_and_toggle(spark):
    items = spark.createDataFrame([("/l", "/l/2023/2023-05", 1), ("/l", "/l/2023-backup", 1), ("/l", "/l", 1)], "source_root string, parent_path string, file_size long")
    tree = {r.path: r for r in views.folder_tree(items, spark.createDataFrame([("/l/2023",)], "path string")).collect()}
    assert tree["/l/2023"].is_excluded and tree["/l/2023/2023-05"].is_inherited and not tree["/l/2023-backup"].is_inherited
    assert sum(r.file_count for r in tree.values()) == 3 and tree["/l"].total_file_count == 3
    marks = spark.createDataFrame([("/l/2023/2023-05",)], "path string")
    on = views.toggle_exclusion(marks, "/l/2023")
    assert [r.path for r in on.collect()] == ["/l/2023"] and views.toggle_exclusion(on, "/l/2023").count() == 0
    deeper = {r.path: r.has_children for r in views.has_children(views.folder_tree(items)).collect()}
    assert deeper["/l"] and deeper["/l/2023"] and not deeper["/l/2023-backup"]


def test_sort_keeps_unknown_times_last(spark):
    df = spark.sql("SELECT * FROM VALUES ('b', TIMESTAMP_NTZ'2020-01-01 00:00:00', 1L), ('a', NULL, 2L), ('c', TIMESTAMP_NTZ'2021-01-01 00:00:00', 3L) AS t(file_name, captured_at, file_size)")
    order = lambda by: [r.file_name for r in views.sort(df, by).collect()]
    assert order("capturedDesc") == ["c", "b", "a"] and order("capturedAsc") == ["b", "c", "a"] and order("sizeDesc") == ["c", "a", "b"]
    assert F is not None


def test_large_checkpoints_are_not_broadcast(spark):
    """A table that a generator has made large is not sent through the driver; a small one may be."""
    grown = lambda n: checkpointed(spark.range(10).select(F.explode(F.sequence(F.lit(1), F.lit(n))).alias("k")))
    plan = lambda n: spark.range(1 << 40).withColumnRenamed("id", "k").join(grown(n), "k")._jdf.queryExecution().executedPlan().toString()
    assert "Broadcast" not in plan(20_000)
    assert "Broadcast" in plan(20)
