"""Applying and undoing a plan as table transitions over the catalogue and a journal. No file is touched."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shutterloom.functions import text
from shutterloom.schema import MESSAGES
from shutterloom.scratch import checkpointed, numbered

from .numbering import free_numbers, suffixed, without_number
from .timeline import entangled

_TRASH_FROM = 1 << 62


def execution_order(op_kind: Column, op_ordinal: Column) -> Column:
    """A sort key, not a running number: cleaning comes after all other operations; two places each, the first for what is displaced."""
    return F.when(op_kind == "trash", F.lit(_TRASH_FROM)).otherwise(F.lit(0).cast("long")) + op_ordinal.cast("long") * 2 + 1


def _touch(entry: str, node: Column, reads: bool = False, fills: Column | bool = False, leaves: Column | bool = False, forced: Column | bool = False) -> Column:
    flag = lambda c: (F.lit(c) if isinstance(c, bool) else c)
    return F.struct(F.col(entry).alias("entry"), node.alias("node"), flag(reads).alias("reads"), flag(fills).alias("fills"), flag(leaves).alias("leaves"), flag(forced).alias("forced"))


def _applied(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Replays operations in order. Rows come sorted by component: first the files that are there (no entry), then the operations."""
    component, files = None, set()
    for batch in batches:
        out: list[tuple] = []
        for own, entry, kind, source, destination, over in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if own != component:
                component, files = own, set()
            if entry is None:
                files.add(source)
                continue
            failed, displaced = None, False
            if source not in files:
                failed = "no_source"
            elif kind != "trash" and destination is None:
                failed = "no_destination"
            elif kind != "trash" and destination in files and not over:
                failed = "occupied"
            elif kind == "trash":
                files.discard(source)
            else:
                displaced = destination in files
                files.discard(destination)
                if source not in files:  # it made room for itself
                    failed = "no_source"
                else:
                    files.add(destination)
                    if kind != "copy":
                        files.discard(source)
            out.append((entry, failed, displaced))
        kinds = (pa.int64(), pa.string(), pa.bool_())
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], k) for i, k in enumerate(kinds)], names=["entry", "failed", "displaced"])


def _replayed_applies(ops: DataFrame, files: DataFrame, tied: DataFrame) -> DataFrame:
    """Rows (_e, _failed, _displaced) of the entangled operations."""
    of_tied = tied.select("entry", "component").distinct()
    there = files.join(tied.select(F.col("node").alias("path"), "component").distinct(), "path").select("component", F.lit(None).cast("long").alias("entry"), F.lit(None).cast("string").alias("op_kind"), F.col("path").alias("source_path"), F.lit(None).cast("string").alias("destination_path"), F.lit(False).alias("overwrites_existing"), F.lit(-1).cast("long").alias("seq"))
    acting = ops.join(of_tied, "entry").select("component", "entry", "op_kind", "source_path", "destination_path", "overwrites_existing", "seq")
    # dealt by a key that no side of the union is dealt by, so that the exchange stays
    ordered = there.unionByName(acting).repartition(F.xxhash64("component")).sortWithinPartitions("component", "seq", "entry")
    done = ordered.drop("seq").mapInArrow(_applied, "entry long, failed string, displaced boolean").withColumnsRenamed({"entry": "_e", "failed": "_failed", "displaced": "_displaced"})
    return checkpointed(done)


def apply_plan(operations: DataFrame, inventory: DataFrame, session_id: str, trash_root: str = "/.trash") -> DataFrame:
    """Journal of the selected mutating operations over the files of `inventory` (path).

    Each operation finds the files as the ones before it have left them: a
    missing source fails, so does a missing or occupied destination, unless the
    operation overwrites; then a row that displaces the old file comes before.
    Operations that share a place where one's outcome depends on another's are
    replayed in order, by components; of others to one destination the first
    with a source has it, which columns tell.
    """
    chosen = operations.filter(F.col("selected") & F.col("op_kind").isin("move", "rename", "copy", "trash"))
    reason = F.col("reason") if "reason" in operations.columns else F.lit(None).cast("string")
    ops = chosen.select("item_id", "op_kind", "source_path", F.when(F.col("op_kind") != "trash", F.col("destination_path")).alias("destination_path"), "file_size", "overwrites_existing", reason.alias("reason"), execution_order(F.col("op_kind"), F.col("op_ordinal")).alias("seq"))
    ops = checkpointed(ops.withColumn("entry", F.monotonically_increasing_id()))
    files = checkpointed(inventory.select("path").distinct())
    leaving, goal = F.col("op_kind") != "copy", F.col("destination_path")
    at_source = _touch("entry", F.col("source_path"), True, False, leaving, F.coalesce(goal == F.col("source_path"), F.lit(False)))
    touches = ops.select(F.inline(F.when(goal.isNull(), F.array(at_source)).otherwise(F.array(at_source, _touch("entry", goal, fills=True)))))
    tied = entangled(touches)

    replayed = _replayed_applies(ops, files, tied) if tied.take(1) else ops.sparkSession.createDataFrame([], "_e long, _failed string, _displaced boolean")
    ops = ops.join(files.select(F.col("path").alias("_s")), F.col("source_path") == F.col("_s"), "left").withColumn("has_source", F.col("_s").isNotNull())
    ops = ops.join(files.select(F.col("path").alias("_d")), goal == F.col("_d"), "left").withColumn("on_disk", F.col("_d").isNotNull())
    turn = F.struct("seq", "entry")
    first = ops.filter("has_source AND destination_path IS NOT NULL").groupBy(goal.alias("_g")).agg(F.min(turn).alias("first"))
    ops = ops.join(first, goal == F.col("_g"), "left").join(replayed, F.col("entry") == F.col("_e"), "left")
    occupied = F.col("on_disk") | F.coalesce(F.col("first") < turn, F.lit(False))
    transfer = F.col("op_kind") != "trash"
    by_columns = F.when(~F.col("has_source"), "no_source").when(transfer & goal.isNull(), "no_destination").when(transfer & occupied & ~F.col("overwrites_existing"), "occupied")
    is_tied = F.col("_e").isNotNull()
    failed = F.when(is_tied, F.col("_failed")).otherwise(by_columns)
    ops = ops.withColumns({"failed": failed, "displaces": F.when(is_tied, F.col("_displaced")).otherwise(by_columns.isNull() & transfer & occupied)})

    in_trash = lambda p: F.concat(F.lit(trash_root), p)
    row = lambda seq, kind, src, dst, result, message, size, trash: F.struct(seq.alias("seq"), kind.alias("op_kind"), src.alias("source_path"), dst.alias("destination_path"), result.alias("result"), message.alias("message"), size.alias("file_size"), trash.alias("trash_path"))
    null, done = F.lit(None).cast("string"), F.col("failed").isNull()
    texts = F.create_map(*[F.lit(x) for k in ("no_source", "no_destination", "occupied") for x in (k, MESSAGES[k])])
    own = row(F.col("seq"), F.col("op_kind"), F.col("source_path"), goal, F.when(done, "success").otherwise("failed"), F.when(done, F.coalesce("reason", F.lit(""))).otherwise(texts[F.col("failed")]), F.col("file_size"), F.when((F.col("op_kind") == "trash") & done, in_trash(F.col("source_path"))))
    displaced = row(F.col("seq") - 1, F.lit("trash"), goal, null, F.lit("success"), F.lit(MESSAGES["displaced"]), F.lit(0).cast("long"), in_trash(goal))
    out = ops.select("item_id", F.inline(F.when(F.col("displaces"), F.array(displaced, own)).otherwise(F.array(own))))
    return out.select(F.lit(session_id).alias("session_id"), "seq", "item_id", "op_kind", "source_path", "destination_path", "result", "message", "file_size", "trash_path", F.lit(False).alias("undone"))


def execution_report(journal: DataFrame, messages: int = 12) -> DataFrame:
    """One row: operations by the result of their last entry, bytes freed, the first messages of failures (file name and text).

    `journal` has op_id (entries of one operation share it), seq, result,
    op_kind, source_path, file_size, message.
    """
    last = journal.groupBy("op_id").agg(F.max_by(F.struct("result", "op_kind", "source_path", "file_size", "message", "seq"), "seq").alias("e")).select("e.*")
    counts = last.agg(
        F.count_if(F.col("result") == "success").alias("succeeded"),
        F.count_if(F.col("result") == "failed").alias("failed"),
        F.count_if(F.col("result") == "skipped").alias("skipped"),
        F.coalesce(F.sum(F.when((F.col("result") == "success") & (F.col("op_kind") == "trash"), F.col("file_size"))), F.lit(0)).alias("reclaimed_bytes"),
        F.lit(1).alias("_one"),
    )
    told = F.concat(text.file_name(F.col("source_path")), F.lit("："), "message")
    said = last.filter("result = 'failed' AND message IS NOT NULL").orderBy("seq").limit(messages).agg(F.transform(F.array_sort(F.collect_list(F.struct("seq", told.alias("told")))), lambda x: x["told"]).alias("messages"), F.lit(1).alias("_one"))
    return counts.join(said, "_one").drop("_one")


def after_apply(items: DataFrame, journal: DataFrame) -> DataFrame:
    """The catalogue after a journal: trashed items go, moved and renamed ones get their new path, name and folder."""
    done = journal.filter("result = 'success' AND NOT undone")
    gone = done.filter("op_kind = 'trash'").select(F.col("source_path").alias("path"))
    moved = done.filter("op_kind IN ('move', 'rename')").groupBy(F.col("source_path").alias("_s")).agg(F.max_by("destination_path", "seq").alias("_d"))
    kept = items.join(gone, "path", "left_anti").join(moved, F.col("path") == F.col("_s"), "left")
    path = F.coalesce("_d", "path")
    return kept.withColumns({"path": path, "file_name": text.file_name(path), "parent_path": text.parent(path)}).drop("_s", "_d")


def _undone(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Takes entries back in order. Rows come sorted by component: first the files that are there (no entry), then the entries, the last one first."""
    component, files, tried = None, set(), {}
    for batch in batches:
        out: list[tuple] = []
        for own, entry, kind, source, now in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if own != component:
                component, files, tried = own, set(), {}
            if entry is None:
                files.add(source)
                continue
            present, target, failed = now in files, None, None
            if kind == "copy":
                files.discard(now)
            elif not present:
                failed = "undo_untold" if now is None else "undo_emptied" if kind == "trash" else "undo_gone"
            elif source not in files:
                target = source
            elif kind == "trash":
                failed = "undo_occupied"
            else:
                folder, _, name = source.rpartition("/")
                stem, dot, ext = name.rpartition(".")
                stem, tail = (stem, dot + ext) if stem and ext else (name, "")
                i = tried.get(source, 1)
                while (target := f"{folder}/{stem}_{i}{tail}") in files:
                    i += 1
                tried[source] = i + 1
            if target is not None:
                files.discard(now)
                files.add(target)
            if kind == "copy" or target is not None:
                tried = {} if now is not None and "_" in now.rpartition("/")[2] else tried  # a number may be free again
            out.append((entry, present, target, failed))
        kinds = (pa.int64(), pa.bool_(), pa.string(), pa.string())
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], k) for i, k in enumerate(kinds)], names=["entry", "present", "target", "failed"])


def _replayed_undos(todo: DataFrame, files: DataFrame, tied: DataFrame) -> DataFrame:
    """Rows (_e, _present, _target, _failed) of the entangled entries."""
    of_tied = tied.select("entry", "component").distinct()
    cut = F.split("node", "\0")
    nodes = tied.select("component", F.element_at(cut, -1).alias("path"), (F.size(cut) == 3).alias("numbers")).distinct()
    numbered_files = without_number(files.withColumns({"dir": text.parent(F.col("path")), "name": text.file_name(F.col("path"))}), "name").withColumn("base", text.child(F.col("dir"), F.col("base_name")))
    of_family = numbered_files.join(nodes.filter("numbers").select("component", F.col("path").alias("_b")), F.col("base") == F.col("_b")).select("component", "path")
    there = files.join(nodes.filter("NOT numbers").select("component", "path").distinct(), "path").select("component", "path").unionByName(of_family)
    listed = there.select("component", F.lit(None).cast("long").alias("entry"), F.lit(None).cast("string").alias("op_kind"), F.col("path").alias("source_path"), F.lit(None).cast("string").alias("now_at"), F.lit(0).alias("acts"), F.lit(None).cast("long").alias("seq"))
    acting = todo.join(of_tied, "entry").select("component", "entry", "op_kind", "source_path", "now_at", F.lit(1).alias("acts"), "seq")
    ordered = listed.unionByName(acting).repartition(F.xxhash64("component")).sortWithinPartitions("component", "acts", F.desc("seq"), F.desc("entry"))
    return checkpointed(ordered.select("component", "entry", "op_kind", "source_path", "now_at").mapInArrow(_undone, "entry long, present boolean, target string, failed string").withColumnsRenamed({"entry": "_e", "present": "_present", "target": "_target", "failed": "_failed"}))


def undo_plan(journal: DataFrame, inventory: DataFrame) -> DataFrame:
    """How to take back what succeeded and isn't undone: undo_order, undo_action, undo_status, from_path, to_path, message.

    Each session by itself, the last entry first, each as the ones before it
    have left the files. An occupied origin of a move gets the first free
    number; an occupied origin of trash is a failure; a copy that is gone is
    undone. Transfers without a destination are left alone. Entries that meet
    where one leaves a place, or where a number may be another's place, are
    replayed in order by components; of others with one origin the first has
    it, and the numbers of the rest are their ranks among what is free.
    """
    now_at = F.when(F.col("op_kind") == "trash", F.col("trash_path")).otherwise(F.col("destination_path"))
    open_rows = journal.filter("result = 'success' AND NOT undone AND op_kind IN ('move', 'rename', 'copy', 'trash')").filter((F.col("op_kind") == "trash") | F.col("destination_path").isNotNull())
    todo = open_rows.select("session_id", "seq", "op_kind", "source_path", now_at.alias("now_at")).withColumn("entry", F.monotonically_increasing_id())
    files = checkpointed(inventory.select("path").distinct())
    todo = todo.join(files.select(F.col("path").alias("_n")), F.col("now_at") == F.col("_n"), "left").join(files.select(F.col("path").alias("_o")), F.col("source_path") == F.col("_o"), "left")
    todo = checkpointed(todo.withColumns({"present": F.col("_n").isNotNull(), "on_disk": F.col("_o").isNotNull()}).drop("_n", "_o"))
    back = F.col("op_kind") != "copy"
    mover = F.col("op_kind").isin("move", "rename")

    session = F.coalesce(F.col("session_id").cast("string"), F.lit("\1"))
    node = lambda p: F.concat(session, F.lit("\0"), p)
    family = lambda p: F.concat(session, F.lit("\0\0"), p)
    # origins where a number may be needed: something is there, or several entries go back to it
    origins = todo.filter(back).groupBy(F.col("session_id").alias("_ss"), F.col("source_path").alias("_p")).agg(F.count("*").alias("_k"), F.max("on_disk").alias("_there"), F.max(mover).alias("_m")).filter("_m AND (_k > 1 OR _there)").drop("_m")
    same = lambda a, b: F.col(a).eqNullSafe(F.col(b))
    origins = checkpointed(origins)
    places = todo.select("entry", "session_id", F.explode(F.when(back, F.array("source_path", "now_at")).otherwise(F.array("now_at"))).alias("place")).filter("place IS NOT NULL")
    met = without_number(places.withColumns({"dir": text.parent(F.col("place")), "name": text.file_name(F.col("place"))}), "name").withColumn("base", text.child(F.col("dir"), F.col("base_name")))
    outside = met.join(origins, same("session_id", "_ss") & (F.col("base") == F.col("_p")), "left_semi")
    at_origin = F.when(back, F.array(_touch("entry", node(F.col("source_path")), fills=True, forced=F.coalesce(F.col("now_at") == F.col("source_path"), F.lit(False)))))
    at_place = F.when(F.col("now_at").isNotNull(), F.array(_touch("entry", node(F.col("now_at")), leaves=True)))
    nothing = F.filter(F.array(_touch("entry", F.lit(""))), lambda _: F.lit(False))
    touches = todo.select(F.inline(F.concat(F.coalesce(at_origin, nothing), F.coalesce(at_place, nothing))))
    wanted = todo.filter(mover).join(origins, same("session_id", "_ss") & (F.col("source_path") == F.col("_p")), "left_semi").select(F.inline(F.array(_touch("entry", family(F.col("source_path")), fills=True))))
    crossing = outside.select(F.inline(F.array(_touch("entry", family(F.col("base")), forced=True))))
    tied = entangled(touches.unionByName(wanted).unionByName(crossing))

    replayed = _replayed_undos(todo, files, tied) if tied.take(1) else todo.sparkSession.createDataFrame([], "_e long, _present boolean, _target string, _failed string")

    calm = todo.join(replayed.select("_e"), F.col("entry") == F.col("_e"), "left_anti")
    turn = F.struct("seq", "entry")
    first = calm.filter(back & F.col("present")).groupBy(F.col("session_id").alias("_ss"), F.col("source_path").alias("_p")).agg(F.max(turn).alias("first"))
    calm = calm.join(first, same("session_id", "_ss") & (F.col("source_path") == F.col("_p")), "left").drop("_ss", "_p")
    calm = checkpointed(calm.withColumn("occupied", F.col("on_disk") | F.coalesce(F.col("first") > turn, F.lit(False))))
    # who needs a number gets the one of their turn, among the numbers that no file has
    queue = calm.filter(F.col("present") & F.col("occupied") & mover).select("session_id", "seq", "entry", text.parent(F.col("source_path")).alias("target_dir"), text.file_name(F.col("source_path")).alias("desired_name"))
    if queue.take(1):
        turns = numbered(queue, ["session_id", "target_dir", "desired_name"], [F.desc("seq"), F.desc("entry")], "turn")
        disk = files.select(text.parent(F.col("path")).alias("disk_dir"), text.file_name(F.col("path")).alias("disk_name"))
        made = free_numbers(turns, disk, ["session_id", "target_dir", "desired_name"]).select(F.col("entry").alias("_m"), text.child(F.col("target_dir"), suffixed(F.col("desired_name"), F.col("number"))).alias("free"))
    else:
        made = queue.select(F.col("entry").alias("_m"), F.lit(None).cast("string").alias("free"))

    rows = todo.join(calm.select(F.col("entry").alias("_c"), "occupied").join(made, F.col("_c") == F.col("_m"), "left"), F.col("entry") == F.col("_c"), "left").join(replayed, F.col("entry") == F.col("_e"), "left")
    is_tied = F.col("_e").isNotNull()
    by_columns = F.when(F.col("op_kind") == "copy", None).when(F.col("now_at").isNull(), "undo_untold").when(~F.col("present"), F.when(F.col("op_kind") == "trash", "undo_emptied").otherwise("undo_gone")).when((F.col("op_kind") == "trash") & F.col("occupied"), "undo_occupied")
    failed = F.when(is_tied, F.col("_failed")).otherwise(by_columns)
    target = F.when(is_tied, F.col("_target")).when(back & by_columns.isNull(), F.when(F.col("occupied"), F.col("free")).otherwise(F.col("source_path")))
    rows = rows.withColumns({"failed": failed, "target": target, "is_there": F.when(is_tied, F.col("_present")).otherwise(F.col("present"))})
    action = F.when(mover, "moveBack").when(F.col("op_kind") == "copy", F.when(F.col("is_there"), "trashCopy").otherwise("none")).otherwise("restore")
    texts = F.create_map(*[F.lit(x) for k in MESSAGES if k.startswith("undo_") for x in (k, MESSAGES[k])])
    message = F.when(F.col("failed").isNotNull(), F.concat(F.lit(MESSAGES["undo_failed"]), texts[F.col("failed")])).when(mover & (F.col("target") != F.col("source_path")), F.concat(F.lit(MESSAGES["undo_renamed"]), text.file_name(F.col("target"))))
    return rows.select("session_id", "seq", (-F.col("seq")).alias("undo_order"), "op_kind", action.alias("undo_action"), F.when(F.col("failed").isNull(), "undone").otherwise("failed").alias("undo_status"), F.col("now_at").alias("from_path"), F.col("target").alias("to_path"), message.alias("message"))


def undo_report(undone: DataFrame) -> DataFrame:
    """Per session: restored, removed copies (those that were still there), failed."""
    done = F.col("undo_status") == "undone"
    return undone.groupBy("session_id").agg(F.count_if(done & (F.col("op_kind") != "copy")).alias("restored"), F.count_if(F.col("undo_action") == "trashCopy").alias("removed_copies"), F.count_if(~done).alias("failed"))
