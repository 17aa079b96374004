"""Applying and undoing against plain loops over random operations that meet at few paths."""

import random

from pyspark.sql import functions as F

from shutterloom.plans import execute, numbering, timeline
from shutterloom.schema import MESSAGES
from shutterloom.scratch import checkpointed

OPS = "item_id long, op_ordinal long, op_kind string, source_path string, destination_path string, file_size long, selected boolean, overwrites_existing boolean, reason string"
JOURNAL = "session_id string, seq long, op_kind string, source_path string, destination_path string, result string, trash_path string, undone boolean"


def numbered_alternative(path, files):
    folder, _, name = path.rpartition("/")
    stem, dot, ext = name.rpartition(".")
    stem, tail = (stem, dot + ext) if stem and ext else (name, "")
    i = 1
    while f"{folder}/{stem}_{i}{tail}" in files:
        i += 1
    return f"{folder}/{stem}_{i}{tail}"


def apply_by_loop(ops, files):
    files, out = set(files), []
    chosen = [o for o in ops if o[6] and o[2] in ("move", "rename", "copy", "trash")]
    for item, _, kind, src, dst, size, _, over, reason in sorted(chosen, key=lambda o: (o[2] == "trash", o[1])):
        fail = lambda m: out.append((item, kind, src, dst if kind != "trash" else None, "failed", MESSAGES[m]))
        if src not in files:
            fail("no_source")
        elif kind == "trash":
            files.remove(src)
            out.append((item, kind, src, None, "success", reason or ""))
        elif dst is None:
            fail("no_destination")
        elif dst in files and not over:
            fail("occupied")
        else:
            if dst in files:
                files.remove(dst)
                out.append((item, "trash", dst, None, "success", MESSAGES["displaced"]))
            if src not in files:
                fail("no_source")
                continue
            if kind != "copy":
                files.remove(src)
            files.add(dst)
            out.append((item, kind, src, dst, "success", reason or ""))
    return out


def undo_by_loop(rows, inventory):
    out = {}
    for session in {r[0] for r in rows}:
        files = set(inventory)
        for _, seq, kind, src, dst, result, trash, undone in sorted((r for r in rows if r[0] == session), key=lambda r: -r[1]):
            now = trash if kind == "trash" else dst
            if result != "success" or undone or kind in ("skipped",) or (kind != "trash" and dst is None):
                continue
            failed, target, message = None, None, None
            if kind == "copy":
                files.discard(now)
            elif now is None:
                failed = "undo_untold"
            elif now not in files:
                failed = "undo_emptied" if kind == "trash" else "undo_gone"
            elif src not in files:
                target = src
            elif kind == "trash":
                failed = "undo_occupied"
            else:
                target = numbered_alternative(src, files)
                message = MESSAGES["undo_renamed"] + target.rpartition("/")[2]
            if target:
                files.discard(now)
                files.add(target)
            out[session, seq] = ("failed" if failed else "undone", target, MESSAGES["undo_failed"] + MESSAGES[failed] if failed else message)
    return out


def applied(spark, ops, files):
    journal = execute.apply_plan(spark.createDataFrame(ops, OPS), spark.createDataFrame([(f,) for f in files], "path string"), "s")
    return [(r.item_id, r.op_kind, r.source_path, r.destination_path, r.result, r.message) for r in journal.orderBy("seq").collect()]


def undone(spark, rows, files):
    plan = execute.undo_plan(spark.createDataFrame(rows, JOURNAL), spark.createDataFrame([(f,) for f in files], "path string"))
    return {(r.session_id, r.seq): (r.undo_status, r.to_path, r.message) for r in plan.collect()}


def test_two_operations_to_one_place(spark):
    """The second finds what the first has put there; a place that was left is free; copies see what came before."""
    op = lambda i, kind, src, dst, over=False, on=True: (i, i, kind, src, dst, 1, on, over, f"r{i}")
    ops = [op(0, "move", "/a/x", "/out/x"), op(1, "move", "/b/x", "/out/x"), op(2, "move", "/c/y", "/a/x"), op(3, "copy", "/d", "/e"), op(4, "copy", "/e", "/f"), op(5, "move", "/g", None), op(6, "move", "/h", "/i", True), op(7, "move", "/j", "/j", True), op(8, "move", "/k", "/l", on=False), op(9, "trash", "/a/x", None)]
    files = ["/a/x", "/b/x", "/c/y", "/d", "/g", "/h", "/i", "/j", "/k"]
    got = applied(spark, ops, files)
    assert got == apply_by_loop(ops, files)
    assert [r[4:] for r in got if r[0] in (1, 2, 4)] == [("failed", MESSAGES["occupied"]), ("success", "r2"), ("success", "r4")]


def test_random_plans_against_a_plain_loop(spark):
    rng = random.Random(3)
    ops, files = [], set()
    for world in range(25):  # few paths each, so that operations meet; some worlds of one kind, so that columns decide
        paths = [f"/{world}/{c}" for c in "abcdefgh"[: rng.randint(2, 8)]]
        outs = [f"/{world}/out/{c}" for c in "xyz"]
        files |= {p for p in paths + outs if rng.random() < 0.6}
        for _ in range(rng.randint(1, 14)):
            kind = rng.choice(["move", "rename", "copy", "trash", "skipped"] if world % 3 else ["move", "copy"])
            i = len(ops)
            goal = rng.choice(outs if world % 3 == 0 else paths + outs)
            ops.append((i, i, kind, rng.choice(paths), None if rng.random() < 0.05 else goal, 1, rng.random() < 0.9, rng.random() < 0.3, rng.choice([None, "why"])))
    assert applied(spark, ops, files) == apply_by_loop(ops, files)


def test_two_moves_from_one_place_go_back_to_two(spark):
    rows = [("s", 1, "move", "/a/x.jpg", "/b/1.jpg", "success", None, False), ("s", 2, "move", "/a/x.jpg", "/b/2.jpg", "success", None, False), ("s", 3, "move", "/a/x.jpg", "/b/3.jpg", "success", None, False)]
    files = ["/b/1.jpg", "/b/2.jpg", "/b/3.jpg"]
    assert {k: v[1] for k, v in undone(spark, rows, files).items()} == {("s", 3): "/a/x.jpg", ("s", 2): "/a/x_1.jpg", ("s", 1): "/a/x_2.jpg"}
    occupied = undone(spark, rows, [*files, "/a/x.jpg", "/a/x_2.jpg"])
    assert {k: v[1] for k, v in occupied.items()} == {("s", 3): "/a/x_1.jpg", ("s", 2): "/a/x_3.jpg", ("s", 1): "/a/x_4.jpg"}


def test_random_journals_against_a_plain_loop(spark):
    """Origins, destinations and numbers that meet, in several sessions, beside many that don't."""
    rng = random.Random(9)
    rows, files = [], set()
    for world in range(30):
        names = [f"/{world}/{n}" for n in ("x.jpg", "x_1.jpg", "x_2.jpg", "x_1_1.jpg", "y", "y_1", ".h")]
        places = [f"/{world}/to/{c}" for c in "abcdef"] + (names if world % 2 else [])
        files |= {p for p in names + places if rng.random() < 0.6}
        for session in rng.sample(["s", "t", "u"], rng.randint(1, 2)):
            for _ in range(rng.randint(1, 10)):
                kind = rng.choice(["move", "rename", "copy", "trash"])
                now = None if rng.random() < 0.1 else rng.choice(places)
                rows.append((session, len(rows), kind, rng.choice(names), now if kind != "trash" else None, rng.choice(["success"] * 5 + ["failed"]), now if kind == "trash" else None, rng.random() < 0.1))
    assert undone(spark, rows, files) == undo_by_loop(rows, files)


def test_many_from_one_place(spark):
    """Two thousand entries from one origin need no replay, and their numbers pass over those that are taken."""
    rows = [("s", i, "move", "/a/x.jpg", f"/b/{i}.jpg", "success", None, False) for i in range(2000)]
    files = [f"/b/{i}.jpg" for i in range(2000)] + ["/a/x.jpg"] + [f"/a/x_{i}.jpg" for i in range(1, 3000, 3)]
    assert undone(spark, rows, files) == undo_by_loop(rows, files)
    touches = spark.createDataFrame([(i, "p", False, True, False, False) for i in range(5)] + [(i, f"q{i}", False, False, True, False) for i in range(5)], "entry long, node string, reads boolean, fills boolean, leaves boolean, forced boolean")
    assert timeline.entangled(touches).count() == 0


def test_free_numbers_by_merged_ranks(spark):
    rng = random.Random(1)
    taken = {n: sorted(rng.sample(range(1, 60), 25)) for n in ("a.jpg", "b", "c.d.e")}
    disk = spark.createDataFrame([("/o", f"{n.rpartition('.')[0] or n}_{k}" + (f".{n.rpartition('.')[2]}" if "." in n else "")) for n, ks in taken.items() for k in ks] + [("/o", "a_007.jpg"), ("/p", "a_1.jpg")], "disk_dir string, disk_name string")
    want = spark.createDataFrame([("/o", n, t) for n in (*taken, "new") for t in range(1, 41)], "target_dir string, desired_name string, turn long")
    got = {(r.desired_name, r.turn): r.number for r in numbering.free_numbers(want, disk, ["target_dir", "desired_name"]).collect()}
    for n in (*taken, "new"):
        free = [k for k in range(1, 200) if k not in taken.get(n, [])]
        assert [got[n, t] for t in range(1, 41)] == free[:40]


def test_chains_hold_only_names_within_reach(spark):
    """Camera names with a date and a time are no numbers of each other; a clash chains only what its numbers reach."""
    rows = [(f"IMG_20230512_{i:06d}.jpg", 1) for i in range(3000)] + [("x.jpg", 3), ("x_1.jpg", 1), ("x_2.jpg", 1), ("x_900.jpg", 1), ("x_1_1.jpg", 1), ("y.jpg", 1), ("y_1.jpg", 2), ("y_1_1.jpg", 1)]
    names = spark.createDataFrame([("/o", n, k, k > 1) for n, k in rows], "target_dir string, desired_name string, n long, wants boolean")
    disk = spark.createDataFrame([("/o", "z.jpg")], "disk_dir string, disk_name string")
    got = {r.desired_name: r.component for r in numbering.chains(names, disk).collect()}
    assert set(got) == {"x.jpg", "x_1.jpg", "x_2.jpg", "x_1_1.jpg", "y_1.jpg", "y_1_1.jpg"}
    assert got["x.jpg"] == got["x_1_1.jpg"] != got["y_1.jpg"]
    assert numbering.chains(names.filter(F.col("desired_name").startswith("IMG")), disk).count() == 0


def test_places_that_are_only_filled_are_not_gone_through(spark, monkeypatch):
    written = []

    def counting(df):
        out = checkpointed(df)
        written.append(out.count())
        return out

    monkeypatch.setattr(timeline, "checkpointed", counting)
    touches = spark.range(300).select(F.col("id").alias("entry"), (F.col("id") % 3).cast("string").alias("node"), F.lit(False).alias("reads"), F.lit(True).alias("fills"), F.lit(False).alias("leaves"), F.lit(False).alias("forced"))
    assert timeline.entangled(touches).count() == 0
    assert written == [300, 3]  # the touches and the places, not once more all that meet there
