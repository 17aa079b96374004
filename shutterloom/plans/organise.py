"""Organise plans: which file goes where, as one table of operations."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from shutterloom import schema
from shutterloom.functions import templates, text
from shutterloom.scratch import FEW_ROWS, checkpointed, counted, numbered, with_group_facts

from .numbering import chains, free_numbers, suffixed, without_number

#: So many depths of excluded folders are looked up one by one.
_MOST_DEPTHS = 8
#: Sources or labels of capture times in reasons.
_BY_DEVICE = ("{camera}", "{make}", "{model}")


@dataclass(frozen=True)
class Rule:
    folder_template: str = templates.FOLDER_PRESETS[2]
    rename_template: str = ""
    destination: str | None = "/out"  # None: below each source root
    conflict: str = "autoNumber"  # autoNumber, skip, overwrite
    transfer: str = "move"  # move, copy
    sequence_start: int = 1
    sequence_padding: int = 4
    unknown_date_folder: str = schema.UNKNOWN_DATE_FOLDER


@dataclass(frozen=True)
class Filter:
    include_images: bool = True
    include_videos: bool = True
    minimum_pixels: int = 0  # of images only
    date_from: str | None = None
    date_to: str | None = None
    minimum_confidence: int = 0
    devices: Sequence[str] = ()
    only_redundant: bool = False
    archive_files: bool = True
    clean_redundant: bool = True


def _column(items: DataFrame, name: str, kind: str = "string") -> Column:
    return F.col(name) if name in items.columns else F.lit(None).cast(kind)


def reject_reason(items: DataFrame, f: Filter) -> Column:
    """The first test that an item fails, in order; null if it passes all."""
    kinds = [k for k, on in (("image", f.include_images), ("video", f.include_videos)) if on]
    pixels = _column(items, "width", "int").cast("long") * _column(items, "height", "int")
    tests: list[tuple[str, Column]] = [("kind", F.col("kind").isin(*kinds) if kinds else F.lit(False))]
    if f.minimum_pixels > 0:
        tests.append(("pixels", (F.col("kind") != "image") | (F.coalesce(pixels, F.lit(0)) >= f.minimum_pixels)))
    if f.date_from:
        tests.append(("date", F.coalesce(F.col("captured_at") >= F.lit(f.date_from).cast("timestamp_ntz"), F.lit(False))))
    if f.date_to:
        tests.append(("date", F.coalesce(F.col("captured_at") <= F.lit(f.date_to).cast("timestamp_ntz"), F.lit(False))))
    tests.append(("confidence", schema.confidence(F.col("time_source")) >= f.minimum_confidence))
    if f.devices:
        tests.append(("device", text.camera_label(_column(items, "make"), _column(items, "model")).isin(*f.devices)))
    if f.only_redundant:
        tests.append(("notRedundant", F.col("is_redundant")))
    reason = F.lit(None).cast("string")
    for name, passed in reversed(tests):
        reason = F.when(~passed, F.lit(name)).otherwise(reason)
    return reason


def considered(items: DataFrame, f: Filter, redundant: DataFrame | None = None, exclusions: DataFrame | None = None) -> DataFrame:
    """Visual items with reject_reason, is_redundant, group_id, keep_name, is_excluded.

    `redundant` (item_id, group_id, disposition, keep_name, dup_kind) lists the
    items that cleaning would remove.
    """
    rows = items.filter(schema.is_visual(F.col("kind")))
    if redundant is None:
        rows = rows.withColumns({"is_redundant": F.lit(False), "group_id": F.lit(None).cast("string"), "disposition": F.lit(None).cast("string"), "keep_name": F.lit(None).cast("string"), "dup_kind": F.lit(None).cast("string")})
    else:
        rows = rows.join(redundant.select("item_id", "group_id", "disposition", "keep_name", "dup_kind"), "item_id", "left").withColumn("is_redundant", F.col("group_id").isNotNull())
    rows = rows.withColumn("reject_reason", reject_reason(rows, f))
    if exclusions is None:
        return rows.withColumn("is_excluded", F.lit(False))
    marks, n = counted(exclusions.select(F.col("path").alias("x"), F.size(F.split("path", "/")).alias("_depth")).filter("_depth > 1").distinct())
    depths = [r["_depth"] for r in marks.select("_depth").distinct().limit(_MOST_DEPTHS + 1).collect()]
    if n <= FEW_ROWS and len(depths) <= _MOST_DEPTHS:
        # few marks: each row looks up the folders above it that are as deep as a mark
        inside = F.lit(False)
        for d in depths:
            rows = rows.join(F.broadcast(marks.filter(F.col("_depth") == d).select(F.col("x").alias(f"_x{d}"))), F.substring_index("parent_path", "/", d) == F.col(f"_x{d}"), "left")
            inside |= F.col(f"_x{d}").isNotNull()
        return rows.withColumn("is_excluded", inside).drop(*[f"_x{d}" for d in depths])
    marks = marks.select("x")
    out = rows.select("parent_path").distinct().select("parent_path", F.explode(text.ancestors(F.col("parent_path"))).alias("x")).join(marks, "x", "left_semi").select("parent_path").distinct()
    return rows.join(out.withColumn("_out", F.lit(True)), "parent_path", "left").withColumn("is_excluded", F.coalesce("_out", F.lit(False))).drop("_out")


def kept_names(decided: DataFrame) -> DataFrame:
    """Rows (group_id, keep_name): the first kept member's name, with the number of kept ones where there are several."""
    kept = decided.filter(~F.col("is_redundant")).groupBy("group_id").agg(F.min_by(text.file_name(F.col("path")), "member_rank").alias("_first"), F.count("*").alias("_n"))
    several = F.concat("_first", F.lit(schema.REASONS["several"][0]), F.col("_n").cast("string"), F.lit(schema.REASONS["several"][1]))
    return kept.select("group_id", F.when(F.col("_n") > 1, several).otherwise(F.col("_first")).alias("keep_name"))


def scan_counters(items: DataFrame) -> DataFrame:
    """Of scanned items: cached_hits and failures."""
    return items.agg(F.count_if(_column(items, "is_hit", "boolean")).alias("cached_hits"), F.count_if(_column(items, "error").isNotNull()).alias("failures"))


def counters(rows: DataFrame) -> DataFrame:
    """considered, filtered_out, excluded: an excluded redundant item counts though it goes on."""
    passed = F.col("reject_reason").isNull()
    return rows.agg(F.count("*").alias("considered"), F.count_if(~passed).alias("filtered_out"), F.count_if(passed & F.col("is_excluded")).alias("excluded"))


def observed(rows: DataFrame, name: str = "counters") -> tuple[DataFrame, Observation]:
    """`rows` of `considered`, and what `counters` says of them once they have been read to the end: no pass of its own."""
    seen = Observation(name)
    passed = F.col("reject_reason").isNull()
    return rows.observe(seen, F.count(F.lit(1)).alias("considered"), F.count_if(~passed).alias("filtered_out"), F.count_if(passed & F.col("is_excluded")).alias("excluded")), seen


def prepared(rows: DataFrame, rule: Rule, f: Filter) -> DataFrame:
    """What goes on to planning, with target folder, sequence number and desired path."""
    kept = rows.filter(F.col("reject_reason").isNull() & (~F.col("is_excluded") | (F.col("is_redundant") & F.lit(f.clean_redundant))))
    if "path" not in kept.columns:
        kept = kept.withColumn("path", F.concat("parent_path", F.lit("/"), "file_name"))
    base = F.col("source_root") if rule.destination is None else F.lit(rule.destination)

    def with_folder(rows: DataFrame, name: str, seq: Column) -> DataFrame:
        # column by column: what is looked at several times is rendered once
        names = templates.variables(templates.Fields.of(rows.columns, seq), rule.sequence_padding, rule.unknown_date_folder)
        rows = rows.withColumn("_rendered", templates.render(rule.folder_template, names))
        unknown = text.sanitize_component(F.lit(rule.unknown_date_folder))
        rows = rows.withColumn("_folder", F.when(F.col("captured_at").isNull(), unknown).otherwise(templates.clean_folder(F.col("_rendered"))))
        return rows.withColumn(name, F.when(F.col("_folder") == "", base).otherwise(F.concat(base, F.lit("/"), F.col("_folder")))).drop("_rendered", "_folder")

    kept = with_folder(kept, "stable_dir", F.lit(0))
    uses_seq = "{seq}" in rule.folder_template or "{seq}" in rule.rename_template
    if uses_seq:
        ranked = numbered(kept, ["stable_dir"], [F.asc_nulls_last("captured_at"), F.asc("file_name"), F.asc("path"), F.asc("item_id")], "seq")
        kept = ranked.withColumn("seq", (F.col("seq") - 1 + rule.sequence_start).cast("int"))
    else:
        kept = kept.withColumn("seq", F.lit(rule.sequence_start))
    kept = with_folder(kept, "target_dir", F.col("seq")) if "{seq}" in rule.folder_template else kept.withColumn("target_dir", F.col("stable_dir"))
    name = F.col("file_name")
    if rule.rename_template.strip():
        ext = text.raw_extension(F.col("file_name"))
        names = templates.variables(templates.Fields.of(kept.columns, F.col("seq")), rule.sequence_padding, rule.unknown_date_folder)
        stem = templates.render_file_name(rule.rename_template, names)
        name = F.when(ext == "", stem).otherwise(F.concat(stem, F.lit("."), ext))
    return kept.withColumn("desired_name", name).withColumn("desired", F.concat("target_dir", F.lit("/"), "desired_name"))


_RESOLVED = "item_id {key}, final_name string, outcome string, note string, overwrites boolean"


def _resolver(policy: str):
    """Gives names in scan order inside each chain of names.

    Rows come sorted by chain, names on disk (no item) first. Only the names of
    one chain are held at a time.
    """

    def resolve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, disk, reserved, counters = None, set(), set(), {}

        def numbered(name: str) -> str:
            stem, dot, ext = name.rpartition(".")
            stem, tail = (stem, dot + ext) if stem else (name, "")
            i = counters.get(name, 1)
            while (made := f"{stem}_{i}{tail}") in reserved or made in disk:
                i += 1
            counters[name] = i  # names are never given back, so the next search starts here
            return made

        for batch in batches:
            out: list[list] = [[] for _ in range(5)]
            for chain, on, item, name, in_place, claimed in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if chain != group:
                    group, disk, reserved, counters = chain, set(), set(), {}
                if on:
                    disk.add(name)
                    continue
                on_disk, in_batch = name in disk, name in reserved
                final, outcome, note, over = name, "transfer", "", False
                if in_place:
                    outcome = "alreadyPlaced"
                elif on_disk or in_batch:
                    if policy == "skip":
                        outcome = "skipped"
                    elif policy == "overwrite" and on_disk and not in_batch and not claimed:
                        over, note = True, schema.NOTES["replaced"]
                    else:
                        final = numbered(name)
                        if policy == "overwrite":
                            note = schema.NOTES["in_batch"] if in_batch else schema.NOTES["claimed"]
                        else:
                            note = schema.NOTES["on_disk"] if on_disk else schema.NOTES["in_batch"]
                reserved.add(final)
                for column, value in zip(out, (item, final, outcome, note, over), strict=True):
                    column.append(value)
            kinds = (batch.schema.field("item_id").type, pa.string(), pa.string(), pa.string(), pa.bool_())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds, strict=True)], names=["item_id", "final_name", "outcome", "note", "overwrites"])

    return resolve


def _wished(rows: DataFrame, known: DataFrame) -> tuple[DataFrame, bool]:
    """Of each wished name: n, first_scan, on_disk, disk_identity, claimed (another item's source stands there); and whether these are few.

    What holds for a name is looked up once for it, not for each of its rows.
    """
    names, n = counted(rows.groupBy("target_dir", "desired_name", "desired").agg(F.count("*").alias("n"), F.when(F.max(F.col("scan_ordinal").isNull()), F.lit(None)).otherwise(F.min("scan_ordinal")).alias("first_scan")))
    few = n <= FEW_ROWS
    sent = F.broadcast if few else lambda df: df.hint("merge")
    there = known.withColumnRenamed("path", "desired").join(sent(names.select("desired")), "desired", "left_semi")
    sources = rows.select(F.col("path").alias("desired")).join(sent(names.select("desired")), "desired", "left_semi").distinct()
    facts = names.join(sent(there.withColumn("_t", F.lit(True))), "desired", "left").join(sent(sources.withColumn("_c", F.lit(True))), "desired", "left")
    claimed = F.col("_c").isNotNull()
    if "file_identity" in rows.columns:
        # one file can have two paths: what stands at the wished place may be the item itself or another item's source
        found = there.select("disk_identity").filter("disk_identity IS NOT NULL").distinct()
        owned = rows.select(F.col("file_identity").alias("disk_identity")).join(sent(found), "disk_identity", "left_semi").distinct()
        left = there.join(sent(owned), "disk_identity", "left_semi").select("desired", F.lit(True).alias("_f"))
        facts = facts.join(sent(left), "desired", "left")
        claimed |= F.col("_f").isNotNull()
    facts = facts.select("target_dir", "desired_name", "n", "first_scan", F.col("_t").isNotNull().alias("on_disk"), "disk_identity", claimed.alias("claimed"))
    return counted(facts)[0], few


def resolved(rows: DataFrame, rule: Rule, inventory: DataFrame) -> DataFrame:
    """Rows to archive with final_name, outcome, note, overwrites.

    Who keeps a name and which number the others get is settled by columns.
    Only where a number could make a name that another row asks for (`x` twice
    beside `x_1`) the rows of that chain of names are replayed in scan order.
    """
    # both are read several times; paths are rendered once
    rows = checkpointed(rows)
    if "file_identity" in inventory.columns:
        known = inventory.groupBy("path").agg(F.max("file_identity").alias("disk_identity"))
    else:
        known = inventory.select("path").distinct().withColumn("disk_identity", F.lit(None).cast("string"))
    known = checkpointed(known)
    disk = known.select(text.parent(F.col("path")).alias("disk_dir"), text.file_name(F.col("path")).alias("disk_name"))
    facts, few = _wished(rows, known)
    keys, columns = ["target_dir", "desired_name"], rows.columns
    rows = with_group_facts(rows, facts, keys, "n", few, "item_id")
    in_place = text.normalize_path(F.col("desired")) == text.normalize_path(F.col("path"))
    if "file_identity" in columns:
        in_place |= F.coalesce(F.col("disk_identity") == F.col("file_identity"), F.lit(False))
    rows = rows.withColumn("in_place", in_place).drop("disk_identity")
    rows = rows if few else checkpointed(rows)
    # items with one scan ordinal have their turns by their ids
    turn = F.struct("scan_ordinal", "item_id")
    first = rows.filter("scan_ordinal <=> first_scan").groupBy(*keys).agg(F.min("item_id").alias("first_item"))
    placed = rows.filter("in_place").groupBy(*keys).agg(F.min(turn).alias("first_placed"))
    turns = facts.select(*keys, "n").join(first, keys).join(placed, keys, "left")
    rows = with_group_facts(rows, turns, keys, "n", few, "item_id")
    is_first = F.col("scan_ordinal").eqNullSafe(F.col("first_scan")) & F.col("item_id").eqNullSafe(F.col("first_item"))
    over = F.lit(rule.conflict == "overwrite") & is_first & F.col("on_disk") & ~F.col("claimed") & ~F.col("in_place")
    # the first row takes the name if it may; else only a file that is in its place has it
    given = ~F.col("on_disk") | (F.lit(rule.conflict == "overwrite") & ~F.col("claimed"))
    in_batch = (given & ~is_first) | F.coalesce(F.col("first_placed") < turn, F.lit(False))
    meets = ~F.col("in_place") & (F.col("on_disk") | ~is_first)
    rows = checkpointed(rows.withColumns({"meets": meets, "over": over, "in_batch": in_batch}).select(*columns, "in_place", "claimed", "on_disk", "meets", "over", "in_batch"))

    wanting = rows.filter("meets AND NOT over")
    if rule.conflict == "skip":
        outcome = F.when(F.col("in_place"), "alreadyPlaced").when(F.col("meets"), "skipped").otherwise("transfer")
        return rows.withColumns({"final_name": F.col("desired_name"), "outcome": outcome, "note": F.lit(""), "overwrites": F.lit(False)}).drop("in_place", "claimed", "on_disk", "meets", "over", "in_batch")

    names = checkpointed(rows.groupBy(*keys).agg(F.count("*").alias("n"), F.max(F.col("meets") & ~F.col("over")).alias("wants")))
    chained = checkpointed(chains(names, disk))
    none_chained = not chained.take(1)
    marked = rows.withColumn("component", F.lit(None).cast("string")) if none_chained else checkpointed(rows.join(chained, ["target_dir", "desired_name"], "left"))

    turns = numbered(marked.filter("component IS NULL AND meets AND NOT over").select("target_dir", "desired_name", "item_id", "scan_ordinal"), ["target_dir", "desired_name"], [F.asc("scan_ordinal"), F.asc("item_id")], "turn")
    free = free_numbers(turns.select("target_dir", "desired_name", "item_id", "turn"), disk, ["target_dir", "desired_name"])
    numbers = free.select("item_id", suffixed(F.col("desired_name"), F.col("number")).alias("made"))
    if rule.conflict == "overwrite":
        why = F.when(F.col("in_batch"), schema.NOTES["in_batch"]).otherwise(schema.NOTES["claimed"])
    else:
        why = F.when(F.col("on_disk"), schema.NOTES["on_disk"]).otherwise(schema.NOTES["in_batch"])
    note = F.when(F.col("over"), schema.NOTES["replaced"]).when(F.col("meets"), why).otherwise("")
    calm = marked.filter("component IS NULL").join(numbers, "item_id", "left").withColumns({"final_name": F.coalesce("made", "desired_name"), "outcome": F.when(F.col("in_place"), "alreadyPlaced").otherwise("transfer"), "note": note, "overwrites": F.col("over")})
    columns, flags = [*rows.columns, "final_name", "outcome", "note", "overwrites"], ("in_place", "claimed", "on_disk", "meets", "over", "in_batch")
    if none_chained:
        return calm.select(columns).drop(*flags)
    kind = {f.name: f.dataType for f in rows.schema}
    # files at the chain's names, and at numbers of these
    made = without_number(disk, "disk_name").select("disk_dir", "disk_name", F.col("base_name").alias("near"))
    files = disk.select("disk_dir", "disk_name", F.col("disk_name").alias("near")).unionByName(made)
    there = files.join(chained, (F.col("disk_dir") == F.col("target_dir")) & (F.col("near") == F.col("desired_name"))).select("component", F.col("disk_name").alias("desired_name")).distinct()
    met = there.select("component", F.lit(True).alias("listed"), F.lit(None).cast(kind["item_id"]).alias("item_id"), "desired_name", F.lit(False).alias("in_place"), F.lit(False).alias("claimed"), F.lit(None).cast(kind["scan_ordinal"]).alias("scan_ordinal"))
    busy = marked.filter("component IS NOT NULL").select("component", F.lit(False).alias("listed"), "item_id", "desired_name", "in_place", "claimed", "scan_ordinal")
    # a union takes over the partitioning that its sides claim, which adaptive execution may change: deal by a key that no side is dealt by
    ordered = busy.unionByName(met).repartition(F.xxhash64("component")).sortWithinPartitions("component", F.desc("listed"), "scan_ordinal", "item_id")
    replayed = ordered.drop("scan_ordinal").mapInArrow(_resolver(rule.conflict), _RESOLVED.format(key=kind["item_id"].simpleString()))
    return calm.select(columns).unionByName(marked.filter("component IS NOT NULL").join(replayed, "item_id").select(columns)).drop(*flags)


def build(rows: DataFrame, rule: Rule, f: Filter, inventory: DataFrame) -> DataFrame:
    """Operations of considered rows: op_ordinal, op_kind, item_id, paths, reason, group_id, file_size, selected, overwrites_existing, target_dir."""
    ready = prepared(rows, rule, f)
    cleaned = F.col("is_redundant") & F.lit(f.clean_redundant)
    label = F.create_map(*[F.lit(x) for kv in schema.GROUP_LABELS.items() for x in kv])
    kind = F.coalesce(label[F.col("dup_kind")], F.col("dup_kind"))
    why = F.when(F.col("disposition") == "discardAll", F.concat(kind, F.lit(schema.REASONS["discardAll"]))).otherwise(F.concat(kind, F.lit(schema.REASONS["kept"]), F.coalesce("keep_name", F.lit(schema.REASONS["unnamed"])), F.lit("」")))
    common = [F.col("scan_ordinal").alias("op_ordinal"), "item_id", F.col("path").alias("source_path")]
    rest = ["group_id", "file_size", F.col("kind").alias("media_kind"), "file_name"]
    trash = ready.filter(cleaned).select(*common, F.lit("trash").alias("op_kind"), F.lit(None).cast("string").alias("destination_path"), why.alias("reason"), *rest, F.lit(True).alias("selected"), F.lit(False).alias("overwrites_existing"), F.lit(None).cast("string").alias("target_dir"))
    if not f.archive_files:
        return trash
    done = resolved(ready.filter(~cleaned), rule, inventory)
    final = F.concat("target_dir", F.lit("/"), "final_name")
    moved = F.lit("copy") if rule.transfer == "copy" else F.when(F.col("target_dir") == text.parent(F.col("path")), "rename").otherwise("move")
    by_device = any(v in rule.folder_template for v in _BY_DEVICE)
    about = F.concat(F.lit(schema.REASONS["by_device"]), text.camera_label(_column(done, "make"), _column(done, "model"))) if by_device else F.when(F.col("captured_at").isNotNull(), F.concat(F.lit(schema.REASONS["taken"]), text.captured_label(F.col("captured_at")), F.lit(schema.REASONS["source"]), F.col("time_source"), F.lit("）"))).otherwise(schema.REASONS["no_time"])
    reason = F.concat_ws(" · ", about, F.lit(schema.REASONS["renamed"] if rule.rename_template.strip() else None), F.when(_column(done, "latitude", "double").isNotNull(), schema.REASONS["gps"]), F.nullif(F.col("note"), F.lit("")))
    op = F.when(F.col("outcome") == "transfer", moved).otherwise(F.col("outcome"))
    place = F.when(F.col("outcome") == "alreadyPlaced", F.col("path")).otherwise(final)
    said = F.when(F.col("outcome") == "alreadyPlaced", schema.REASONS["placed"]).when(F.col("outcome") == "skipped", schema.REASONS["skipped"]).otherwise(reason)
    archive = done.select(*common, op.alias("op_kind"), place.alias("destination_path"), said.alias("reason"), F.lit(None).cast(ready.schema["group_id"].dataType).alias("group_id"), *rest[1:], (F.col("outcome") == "transfer").alias("selected"), F.col("overwrites").alias("overwrites_existing"), "target_dir")
    return trash.unionByName(archive)


def trash_only(items: DataFrame, picked: DataFrame) -> DataFrame:
    """Exactly the picked (item_id) visual items, in scan order, whatever rules and filters say."""
    chosen = items.filter(schema.is_visual(F.col("kind"))).join(picked.select("item_id"), "item_id", "left_semi")
    return chosen.select(F.col("scan_ordinal").alias("op_ordinal"), "item_id", F.concat("parent_path", F.lit("/"), "file_name").alias("source_path"), F.lit("trash").alias("op_kind"), "file_size", F.lit(True).alias("selected")).orderBy("op_ordinal")


def trash_only_warnings(members: DataFrame, picked: DataFrame) -> DataFrame:
    """Rows (code, n, bytes): files picked and their bytes, groups picked as a whole and their members, picked members that are to be kept."""
    whole = F.col("disposition") == "keepAll" if "disposition" in members.columns else F.lit(False)
    stays = whole | (F.col("is_keep") & (F.col("disposition") != "discardAll") if "disposition" in members.columns else F.col("is_keep"))
    mine = members.join(picked.select("item_id", F.lit(1).alias("p")), "item_id", "left")
    per = mine.groupBy("group_id").agg(F.count("*").alias("m"), F.count("p").alias("k"), F.count_if(stays & F.col("p").isNotNull()).alias("keepers"))
    facts = per.agg(F.count_if(F.col("m") == F.col("k")).alias("whole_groups"), F.coalesce(F.sum(F.when(F.col("m") == F.col("k"), F.col("m"))), F.lit(0)).alias("whole_group_members"), F.coalesce(F.sum("keepers"), F.lit(0)).alias("picked_keepers"))
    named = facts.select(F.inline(F.array(*[F.struct(F.lit(c).alias("code"), F.col(c).alias("n"), F.lit(0).cast("long").alias("bytes")) for c in ("whole_groups", "whole_group_members", "picked_keepers")])))
    total = picked.agg(F.count("*").alias("n"), F.coalesce(F.sum("file_size"), F.lit(0)).cast("long").alias("bytes"))
    return total.select(F.lit("picked").alias("code"), "n", "bytes").unionByName(named)


def transfer_summary(operations: DataFrame) -> DataFrame:
    """One row: counts and bytes by kind; moves, renames, copies and trash only if selected."""
    aggs = []
    for kind, name in (("move", "move"), ("rename", "rename"), ("copy", "copy"), ("trash", "trash")):
        hit = (F.col("op_kind") == kind) & F.col("selected")
        aggs += [F.count_if(hit).alias(f"{name}_count"), F.coalesce(F.sum(F.when(hit, F.col("file_size"))), F.lit(0)).alias(f"{name}_bytes")]
    return operations.agg(*aggs, F.count_if(F.col("op_kind") == "skipped").alias("skipped_count"), F.count_if(F.col("op_kind") == "alreadyPlaced").alias("already_placed_count"))


def folder_counts(operations: DataFrame) -> DataFrame:
    """Files per target folder, of operations that put a file there."""
    return operations.filter(F.col("op_kind").isin("move", "rename", "copy")).groupBy("target_dir").agg(F.count("*").alias("n"))


def folder_preview(operations: DataFrame, destination: str, top: int = 24) -> DataFrame:
    relative = text.relative_path(F.col("target_dir"), F.lit(destination))
    return folder_counts(operations).select(F.coalesce(relative, F.col("target_dir")).alias("folder"), "n").orderBy("folder").limit(top)


def warnings(rows: DataFrame, operations: DataFrame, rule: Rule, f: Filter, groups: DataFrame | None = None, exclusions: DataFrame | None = None) -> DataFrame:
    """Facts behind a plan's warnings: rows (code, n, bytes) with n > 0."""
    # counted over one pass of the items and one of the operations
    facts = rows.agg(F.count_if(F.col("captured_at").isNull() | (F.col("time_source") == "none")).alias("unknown_time"), F.count_if(F.col("time_source") == "fileSystem").alias("filesystem_time"), F.count_if(F.col("reject_reason").isNull() & F.col("is_excluded")).alias("excluded_files"))
    spark = rows.sparkSession
    one = lambda df, names: df.select(F.inline(F.array(*[F.struct(F.lit(c).alias("code"), F.col(n).cast("long").alias("n"), F.col(b).cast("long").alias("bytes") if b else F.lit(0).cast("long").alias("bytes")) for c, n, b in names])))
    out = one(facts, [(c, c, None) for c in ("unknown_time", "filesystem_time", "excluded_files")])
    sums = transfer_summary(operations)
    named = ([("moves", "move_count", "move_bytes")] if rule.transfer == "move" else []) + ([("trash", "trash_count", "trash_bytes")] if f.clean_redundant else [])
    if named:
        out = out.unionByName(one(sums, named))
    if groups is not None:
        hit = groups.filter(F.col("disposition") == "discardAll") if f.clean_redundant else groups
        code = "discarded_groups" if f.clean_redundant else "uncleaned_groups"
        sums = hit.agg(F.count("*").alias("n"), F.coalesce(F.sum("member_count"), F.lit(0)).alias("m"))
        out = out.unionByName(one(sums, [(code, "n", None), *([("discarded_members", "m", None)] if f.clean_redundant else [])]))
    if rule.destination is not None:
        inside = rows.select("source_root").distinct().agg(F.count_if(text.is_under(F.lit(rule.destination), F.col("source_root"))).alias("n"))
        out = out.unionByName(one(inside.select(F.least("n", F.lit(1)).alias("n")), [("destination_inside_source", "n", None)]))
    fixed = [("unknown_folder_variables", len(templates.unknown_variables(rule.folder_template)), 0), ("unknown_rename_variables", len(templates.unknown_variables(rule.rename_template)), 0), ("overwrite_policy", int(rule.conflict == "overwrite"), 0)]
    if exclusions is not None:
        out = out.unionByName(exclusions.agg(F.count("*").alias("n")).select(F.lit("excluded_folders").alias("code"), "n", F.lit(0).cast("long").alias("bytes")))
    return out.unionByName(spark.createDataFrame(fixed, "code string, n long, bytes long")).filter("n > 0")


def combined(one: DataFrame, two: DataFrame, how: str) -> DataFrame:
    """A selection of items (item_id) by two others: union, intersect or subtract."""
    a, b = one.select("item_id").distinct(), two.select("item_id").distinct()
    return a.union(b).distinct() if how == "union" else a.join(b, "item_id", "left_semi" if how == "intersect" else "left_anti")


def of_kinds(operations: DataFrame, *kinds: str) -> DataFrame:
    """Operations of some kinds; all without any."""
    return operations.filter(F.col("op_kind").isin(*kinds)) if kinds else operations


def mutating(operations: DataFrame) -> DataFrame:
    """What would change files: selected operations of mutating kinds."""
    return operations.filter(F.col("selected") & F.col("op_kind").isin(*schema.MUTATING))


def destructive(operations: DataFrame) -> DataFrame:
    """What would go to the trash."""
    return operations.filter(F.col("selected") & (F.col("op_kind") == "trash"))


def select_operations(operations: DataFrame, on: bool, kinds: Sequence[str] = schema.MUTATING) -> DataFrame:
    """Set or clear the mark of mutating operations of some kinds."""
    hit = F.col("op_kind").isin(*[k for k in kinds if k in schema.MUTATING])
    return operations.withColumn("selected", F.when(hit, F.lit(on)).otherwise(F.col("selected")))


def select_only(operations: DataFrame, what: str) -> DataFrame:
    """Only the archiving operations (`archive`) or only the cleaning ones (`trash`)."""
    wanted = F.col("op_kind") == "trash" if what == "trash" else F.col("op_kind").isin("move", "rename", "copy")
    return operations.withColumn("selected", F.col("op_kind").isin(*schema.MUTATING) & wanted)


def override_selection(operations: DataFrame, overrides: DataFrame) -> DataFrame:
    """Marks of single operations from rows (item_id, on)."""
    given = overrides.select("item_id", "on")
    return operations.join(given, "item_id", "left").withColumn("selected", F.when(F.col("op_kind").isin(*schema.MUTATING), F.coalesce("on", "selected")).otherwise(F.col("selected"))).drop("on")
