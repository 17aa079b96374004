import functools
import random

from pyspark.sql import functions as F

from shutterloom import scratch
from shutterloom.plans import execute, organise

ITEM = "item_id long, scan_ordinal long, source_root string, path string, file_name string, parent_path string, kind string, captured_at timestamp_ntz, time_source string, model string, file_size long"


def catalogue(spark, paths, dated=True):
    rows = [(i, i, "/src", p, p.rsplit("/", 1)[1], p.rsplit("/", 1)[0], "image", None, "exif" if dated else "none", None, 10) for i, p in enumerate(paths)]
    df = spark.createDataFrame(rows, ITEM)
    return df.withColumn("captured_at", F.lit("2023-05-10 12:00:00").cast("timestamp_ntz")) if dated else df


def plan(spark, items, taken=(), **rule):
    r, f = organise.Rule(folder_template="{yyyy}", **rule), organise.Filter()
    inventory = spark.createDataFrame([(p,) for p in taken], "path string")
    return organise.build(organise.considered(items, f), r, f, inventory)


def shown(ops):
    return {r.item_id: (r.op_kind, r.destination_path, r.overwrites_existing) for r in ops.collect()}


def test_placed_taken_and_equal_names(spark):
    items = catalogue(spark, ["/out/2023/x.jpg", "/a/y.jpg", "/b/y.jpg", "/c/z.jpg"])
    got = shown(plan(spark, items, ["/out/2023/x.jpg", "/out/2023/z.jpg"]))
    assert got == {0: ("alreadyPlaced", "/out/2023/x.jpg", False), 1: ("move", "/out/2023/y.jpg", False), 2: ("move", "/out/2023/y_1.jpg", False), 3: ("move", "/out/2023/z_1.jpg", False)}
    skipped = shown(plan(spark, items, ["/out/2023/x.jpg", "/out/2023/z.jpg"], conflict="skip"))
    assert skipped[2][0] == skipped[3][0] == "skipped"
    over = shown(plan(spark, items, ["/out/2023/x.jpg", "/out/2023/z.jpg"], conflict="overwrite"))
    assert over[3] == ("move", "/out/2023/z.jpg", True) and over[2][1] == "/out/2023/y_1.jpg"


def test_swap_never_overwrites_a_source(spark):
    items = catalogue(spark, ["/out/2023/a.jpg", "/src/b.jpg"]).withColumn("file_name", F.when(F.col("item_id") == 0, "b.jpg").otherwise("a.jpg"))
    got = shown(plan(spark, items, ["/out/2023/a.jpg", "/out/2023/b.jpg"], conflict="overwrite"))
    assert got[0][2] and got[1] == ("move", "/out/2023/a_1.jpg", False)


def test_numbering_against_a_plain_loop(spark):
    rng = random.Random(5)
    names = [f"{rng.choice(['x', 'x_1', 'x_2', 'x_1_1', 'y'])}.jpg" for _ in range(60)]
    taken = {f"/out/2023/{n}" for n in ("x.jpg", "x_3.jpg", "y_1.jpg")}
    reserved, want = set(), {}
    for i, n in enumerate(names):
        desired = f"/out/2023/{n}"
        final, k = desired, 0
        while final in reserved or final in taken:
            k += 1
            final = f"/out/2023/{n[:-4]}_{k}.jpg"
        reserved.add(final)
        want[i] = final
    got = shown(plan(spark, catalogue(spark, [f"/d{i}/{n}" for i, n in enumerate(names)]), taken))
    assert {i: g[1] for i, g in got.items()} == want


def test_unknown_dates_copy_and_rename(spark):
    items = catalogue(spark, ["/a/q.jpg"], dated=False)
    assert shown(plan(spark, items))[0][1] == "/out/未识别日期/q.jpg"
    assert shown(plan(spark, items, transfer="copy"))[0][0] == "copy"
    same = catalogue(spark, ["/out/2023/q.jpg"])
    assert shown(plan(spark, same, rename_template="n_{seq}"))[0][:2] == ("rename", "/out/2023/n_0001.jpg")


def test_execute_then_undo_restores_paths(spark):
    items = catalogue(spark, ["/a/y.jpg", "/b/y.jpg", "/c/z.jpg"])
    ops = plan(spark, items, ["/out/2023/z.jpg"], conflict="overwrite")
    files = items.select("path").unionByName(spark.createDataFrame([("/out/2023/z.jpg",)], "path string"))
    journal = execute.apply_plan(ops, files, "s")
    assert journal.count() == 4 and journal.filter("result = 'failed'").count() == 0  # one row more for what is displaced
    after = execute.after_apply(items, journal)
    assert {r.path for r in after.collect()} == {"/out/2023/y.jpg", "/out/2023/y_1.jpg", "/out/2023/z.jpg"}
    now = after.select("path").unionByName(journal.filter("trash_path IS NOT NULL").select(F.col("trash_path").alias("path")))
    back = {r.from_path: (r.undo_status, r.to_path) for r in execute.undo_plan(journal, now).collect()}
    assert back["/out/2023/y.jpg"] == ("undone", "/a/y.jpg") and back["/.trash/out/2023/z.jpg"] == ("undone", "/out/2023/z.jpg")
    assert execute.undo_report(execute.undo_plan(journal, now)).first().restored == 4


def test_undo_gives_a_number_where_the_origin_is_occupied(spark):
    journal = spark.createDataFrame([("s", 1, "move", "/a/x.jpg", "/b/x.jpg", "success", None, False), ("s", 2, "copy", "/a/c.jpg", "/b/c.jpg", "success", None, False)], "session_id string, seq long, op_kind string, source_path string, destination_path string, result string, trash_path string, undone boolean")
    files = spark.createDataFrame([("/b/x.jpg",), ("/a/x.jpg",), ("/a/x_1.jpg",)], "path string")
    got = {r.seq: (r.undo_action, r.undo_status, r.to_path) for r in execute.undo_plan(journal, files).collect()}
    assert got == {1: ("moveBack", "undone", "/a/x_2.jpg"), 2: ("none", "undone", None)}


def test_failures_and_missing_sources(spark):
    items = catalogue(spark, ["/a/y.jpg"])
    journal = execute.apply_plan(plan(spark, items), spark.createDataFrame([("/out/2023/y.jpg",)], "path string"), "s")
    assert [r.result for r in journal.collect()] == ["failed"]


def test_empty_tables(spark):
    items = catalogue(spark, ["/a/y.jpg"]).limit(0)
    assert plan(spark, items).count() == 0
    assert organise.transfer_summary(plan(spark, items)).first().move_count == 0


def test_wished_names_of_any_number_and_size(spark, monkeypatch):
    # names too many to be sent to every task, groups too large for one, scan ordinals that several items share
    rng = random.Random(9)
    items = catalogue(spark, [f"/d{i}/{rng.choice('xyz')}.jpg" for i in range(40)] + ["/out/2023/x.jpg", "/out/2023/w.jpg"]).withColumn("scan_ordinal", F.when(F.col("item_id") % 7 > 0, F.col("item_id") % 5))
    taken = ["/out/2023/x.jpg", "/out/2023/w.jpg", "/out/2023/y_2.jpg"]
    want = {how: shown(plan(spark, items, taken, conflict=how)) for how in ("skip", "overwrite")}
    monkeypatch.setattr(organise, "FEW_ROWS", 0)
    monkeypatch.setattr(organise, "with_group_facts", functools.partial(scratch.with_group_facts, most=4))
    assert {how: shown(plan(spark, items, taken, conflict=how)) for how in ("skip", "overwrite")} == want


def test_a_large_group_meets_its_facts_in_several_tasks(spark):
    rows = spark.range(100).select("id", F.when(F.col("id") < 90, "a").otherwise("b").alias("k"))
    facts = rows.groupBy("k").agg(F.count("*").alias("n"), F.max("id").alias("last"))
    got = scratch.with_group_facts(rows, facts, ["k"], "n", False, "id", most=10)
    assert "_part" in got._jdf.queryExecution().toString()
    assert sorted(map(tuple, got.select("id", "k", "last").collect())) == [(i, "a" if i < 90 else "b", 89 if i < 90 else 99) for i in range(100)]


def test_folders_are_rendered_once(spark):
    items = catalogue(spark, ["/a/y.jpg"], dated=False).withColumn("captured_at", F.timestamp_seconds("item_id").cast("timestamp_ntz"))
    rows = organise.prepared(organise.considered(items, organise.Filter()), organise.Rule(), organise.Filter())
    assert rows.select("desired")._jdf.queryExecution().optimizedPlan().toString().count("date_format(") == 3


def test_excluded_folders_of_few_depths_move_no_rows(spark):
    items = catalogue(spark, ["/a/b/x.jpg", "/a/bc/x.jpg", "/a/b/c/x.jpg", "/d/x.jpg", "/e/f/x.jpg", "/x.jpg"])
    marks = spark.createDataFrame([("/a/b",), ("/d",), ("/e/f/x.jpg",), ("nowhere",)], "path string")
    rows = organise.considered(items, organise.Filter(), None, marks)
    assert "Exchange hashpartitioning" not in rows._jdf.queryExecution().toString()
    got = {r.item_id for r in rows.filter("is_excluded").collect()}
    assert got == {0, 2, 3}


def test_many_depths_of_excluded_folders(spark):
    deep = "/".join([""] + list("abcdefghijkl"))
    items = catalogue(spark, [f"{deep}/x.jpg", "/a/x.jpg", "/b/x.jpg"])
    marks = spark.createDataFrame([("/q" + "/r" * i,) for i in range(12)] + [("/a/b/c",), ("/b",)], "path string")
    assert {r.item_id for r in organise.considered(items, organise.Filter(), None, marks).filter("is_excluded").collect()} == {0, 2}
