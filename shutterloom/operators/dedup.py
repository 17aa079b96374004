"""Duplicate groups: exact and similar copies in one graph, the copy to keep, decisions, bytes to be freed."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shutterloom import schema
from shutterloom.functions import text
from shutterloom.scratch import checkpointed, numbered

from . import similarity
from .components import connected_components, spanning_forest


def confirmed_hashes(items: DataFrame, contents: DataFrame) -> DataFrame:
    """`items` with content_hash only where the quick signature occurs more than once.

    `contents` (item_id, content) is read for these items alone.
    """
    twice = items.filter("quick_signature IS NOT NULL").groupBy(F.col("quick_signature").alias("q")).agg(F.count("*").alias("m")).filter("m > 1")
    asked = items.join(twice, F.col("quick_signature") == F.col("q"), "left_semi").select("item_id")
    hashed = contents.join(asked, "item_id", "left_semi").select(F.col("item_id").alias("i"), F.sha2(F.col("content").cast("binary"), 256).alias("content_hash"))
    return items.drop("content_hash").join(hashed, F.col("item_id") == F.col("i"), "left").drop("i")


def identity_links(items: DataFrame) -> DataFrame:
    """Links (a, b, 0) from the smallest item of each (kind, identity) to the others: a star, never all pairs."""
    anchor = items.groupBy(F.col("kind").alias("k"), F.col("identity").alias("i")).agg(F.min("item_id").alias("a"), F.count("*").alias("m")).filter("m > 1")
    return items.join(anchor, (F.col("kind") == F.col("k")) & (F.col("identity") == F.col("i"))).filter("item_id <> a").select("a", F.col("item_id").alias("b"), F.lit(0).alias("distance"))


def exact_groups(items: DataFrame) -> DataFrame:
    """Groups by (kind, identity) alone: rows (group_id, item_id) of groups of two or more; no graph is needed."""
    heads = items.groupBy(F.col("kind").alias("k"), F.col("identity").alias("i")).agg(F.min("item_id").alias("group_id"), F.count("*").alias("m")).filter("m > 1")
    return items.join(heads, (F.col("kind") == F.col("k")) & (F.col("identity") == F.col("i"))).select("group_id", "item_id")


def clusters(links: DataFrame) -> DataFrame:
    """Rows (group_id, item_id) of the components of links (a, b); named by the smallest item."""
    return connected_components(links, "a", "b").select(F.col("component").alias("group_id"), F.col("node").alias("item_id"))


def rank_columns(exact: Column) -> list[Column]:
    """The order of members from the one to keep on: for exact groups trust, depth, name; for similar ones pixels, trust, size, depth, path."""
    trust, depth = schema.confidence(F.col("time_source")), text.path_depth(F.col("path"))
    pixels = F.greatest(F.lit(0), F.col("width").cast("long") * F.col("height"))
    return [
        F.when(exact, 0).otherwise(-pixels),
        -trust,
        F.when(exact, 0).otherwise(-F.col("file_size")),
        depth,
        F.when(exact, F.length(text.file_name(F.col("path")))).otherwise(F.length("path")),
        F.col("path"),
        F.col("item_id"),
    ]


def groups_and_members(items: DataFrame, membership: DataFrame, links: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(groups, members) of a membership (group_id, item_id).

    groups: group_id, dup_kind, member_count, max_distance, keep_reason.
    members: group_id, item_id, member_rank (1 is the one to keep, then by size and path), is_keep, path, file_size.
    The best member, the second and the best one with another content are
    found by aggregations, members are numbered in parts, so that no task
    holds a whole group.
    """
    captured = F.col("captured_at") if "captured_at" in items.columns else F.lit(None).cast("timestamp_ntz")
    used = ["item_id", "kind", "identity", "time_source", "width", "height", "file_size", "path"]
    joined = checkpointed(membership.join(items.select(*used, captured.alias("captured")), "item_id"))
    per = joined.groupBy("group_id").agg((F.min("identity") == F.max("identity")).alias("exact"), F.count("*").alias("member_count"), F.min("kind").alias("kind")).filter("member_count > 1")
    trust, depth = schema.confidence(F.col("time_source")), text.path_depth(F.col("path"))
    pixels = F.greatest(F.lit(0), F.col("width").cast("long") * F.col("height"))
    # all rank columns count upwards, so the smallest struct is the best member
    order = F.struct(*[c.alias(f"c{i}") for i, c in enumerate(rank_columns(F.col("exact")))])
    view = F.struct(order.alias("order"), trust.alias("trust"), depth.alias("depth"), pixels.alias("pixels"), "file_size", "captured", "identity", "item_id")
    rows = joined.join(per.select("group_id", "exact"), "group_id").select("group_id", "item_id", "path", "file_size", view.alias("v"))
    best = rows.groupBy("group_id").agg(F.min("v").alias("best"))
    beside = rows.join(best, "group_id").filter("v.item_id <> best.item_id")
    others = beside.groupBy("group_id").agg(F.min("v").alias("second"), F.min(F.when(F.col("v.identity") != F.col("best.identity"), F.col("v"))).alias("rival"))
    exact_reason = F.when(F.col("best.trust") != F.col("second.trust"), "trustedTimestamp").when(F.col("best.depth") != F.col("second.depth"), "shallowestPath").otherwise("exactDuplicate")
    similar_reason = (
        F.when(F.col("rival").isNull(), "exactDuplicate")
        .when(F.col("best.pixels") != F.col("rival.pixels"), "highestResolution")
        .when(F.col("best.trust") != F.col("rival.trust"), "trustedTimestamp")
        .when(F.col("best.file_size") != F.col("rival.file_size"), "largestFile")
        .when(F.coalesce(F.col("best.captured") != F.col("rival.captured"), F.lit(False)), "earliestCapture")
        .otherwise("shallowestPath")
    )
    if links is None:
        distances = per.select("group_id", F.lit(0).alias("most"))
    else:
        distances = links.join(membership, F.col("a") == F.col("item_id")).groupBy("group_id").agg(F.max("distance").alias("most"))
    similar = F.when(F.col("kind") == "video", "similarVideo").otherwise("similarImage")
    groups = per.join(best, "group_id").join(others, "group_id").join(distances, "group_id", "left").select(
        "group_id",
        F.when(F.col("exact"), "exact").otherwise(similar).alias("dup_kind"),
        "member_count",
        F.when(F.col("exact"), 0).otherwise(F.coalesce("most", F.lit(0))).cast("int").alias("max_distance"),
        F.when(F.col("exact"), exact_reason).otherwise(similar_reason).alias("keep_reason"),
    )
    shown = rows.join(best, "group_id").select("group_id", "item_id", "path", "file_size", (F.col("v.item_id") == F.col("best.item_id")).alias("is_keep"))
    members = numbered(shown, ["group_id"], [F.desc("is_keep"), F.desc("file_size"), F.asc("path"), F.asc("item_id")], "member_rank")
    return groups, members.select("group_id", "item_id", F.col("member_rank").cast("int").alias("member_rank"), "is_keep", "path", "file_size")


def _one_kept(members: DataFrame) -> DataFrame:
    """Members with is_keep; a group that would be left with none keeps its first member."""
    none = members.groupBy("group_id").agg(F.max("is_keep").alias("_any"), F.min("member_rank").alias("_first")).filter("NOT _any").select(F.col("group_id").alias("_g"), "_first")
    left = members.join(none, F.col("group_id") == F.col("_g"), "left")
    return left.withColumn("is_keep", F.col("is_keep") | F.coalesce(F.col("member_rank") == F.col("_first"), F.lit(False))).drop("_g", "_first")


def apply_decisions(members: DataFrame, kept: DataFrame | None = None, dispositions: DataFrame | None = None) -> DataFrame:
    """Members with is_keep, disposition and is_redundant after the user's decisions.

    `kept` (group_id, item_id, keep) overrides single members; a group that
    would be left with none keeps its first member. `dispositions` (group_id,
    disposition) is bySelection, keepAll or discardAll.
    """
    if kept is not None:
        members = members.join(kept.select(F.col("group_id").alias("g"), F.col("item_id").alias("i"), "keep"), (F.col("group_id") == F.col("g")) & (F.col("item_id") == F.col("i")), "left").withColumn("is_keep", F.coalesce("keep", "is_keep")).drop("g", "i", "keep")
    members = _one_kept(members)
    if dispositions is None:
        members = members.withColumn("disposition", F.lit("bySelection"))
    else:
        members = members.join(dispositions, "group_id", "left").withColumn("disposition", F.coalesce("disposition", F.lit("bySelection")))
    return members.withColumn("is_redundant", F.when(F.col("disposition") == "keepAll", False).when(F.col("disposition") == "discardAll", True).otherwise(~F.col("is_keep")))


def recluster(items: DataFrame, threshold: int) -> tuple[DataFrame, DataFrame]:
    """(groups, members) of fingerprinted items at another threshold; hashes and contents aren't looked at again.

    Images need phash, width, height and color_sig; videos, if any, frames and
    duration.
    """
    links = identity_links(items).unionByName(similarity.image_links(items.filter("kind = 'image'"), threshold, joins_only=True))
    if "frames" in items.columns:
        links = links.unionByName(similarity.video_links(items.filter("kind = 'video'"), threshold))
    links = checkpointed(links)
    return groups_and_members(items, clusters(links), links)


@dataclass(frozen=True)
class LinkedImages:
    """Links of images at the largest threshold, and what a smaller one needs of them."""

    links: DataFrame
    forest: DataFrame


def linked_images(items: DataFrame, most: int = similarity.MOST_THRESHOLD) -> LinkedImages:
    """Identity links and links of images of up to `most` bits, found once, with their spanning forest."""
    found = identity_links(items).unionByName(similarity.image_links(items.filter("kind = 'image'"), most))
    links = checkpointed(found)
    return LinkedImages(links, checkpointed(spanning_forest(links)))


def recluster_linked(items: DataFrame, linked: LinkedImages, threshold: int) -> tuple[DataFrame, DataFrame]:
    """`recluster` of images at any threshold up to that of `linked`: no hash is compared again, only links of the forest are joined."""
    within = F.col("distance") <= min(similarity.MOST_THRESHOLD, max(0, threshold))
    membership = clusters(linked.forest.filter(within))
    return groups_and_members(items, membership, linked.links.filter(within))


def of_kind(groups: DataFrame, dup_kind: str | None) -> DataFrame:
    """Groups of one kind (exact, similarImage, similarVideo); all for None."""
    return groups if dup_kind is None else groups.filter(F.col("dup_kind") == dup_kind)


def toggle_keep(decided: DataFrame, clicks: DataFrame) -> DataFrame:
    """Members after a click on one member of some groups: `clicks` (group_id, item_id), one a group.

    A kept member is given up unless it is the last one; another is kept too.
    The group then goes by selection, whatever it had before, and its reason is
    `manual`, unless nothing changed. `decided` comes from `apply_decisions`.
    """
    clicked = clicks.select(F.col("group_id").alias("_g"), F.col("item_id").alias("_i"))
    rows = decided.join(clicked, F.col("group_id") == F.col("_g"), "left").withColumn("_hit", F.coalesce(F.col("item_id") == F.col("_i"), F.lit(False)))
    facts = rows.filter("_g IS NOT NULL").groupBy(F.col("group_id").alias("_f")).agg(F.max("_hit").alias("_known"), F.count_if("is_keep").alias("_kept"), F.max(F.col("_hit") & F.col("is_keep")).alias("_was"))
    rows = rows.join(facts, F.col("group_id") == F.col("_f"), "left").withColumn("_known", F.coalesce("_known", F.lit(False))).drop("_f")
    changed = F.col("_known") & ~F.coalesce(F.col("_was") & (F.col("_kept") <= 1), F.lit(False))
    keep = F.when(changed & F.col("_hit"), ~F.col("is_keep")).otherwise(F.col("is_keep"))
    reason = F.col("keep_reason") if "keep_reason" in decided.columns else F.lit(None).cast("string")
    rows = rows.withColumns({"keep_reason": F.when(changed, F.lit("manual")).otherwise(reason), "is_keep": keep, "disposition": F.when(F.col("_known"), "bySelection").otherwise(F.col("disposition"))})
    rows = rows.withColumn("is_redundant", F.when(F.col("disposition") == "keepAll", False).when(F.col("disposition") == "discardAll", True).otherwise(~F.col("is_keep")))
    return rows.drop("_g", "_i", "_hit", "_known", "_kept", "_was")


def toggle_disposition(dispositions: DataFrame, clicks: DataFrame) -> DataFrame:
    """Dispositions (group_id, disposition) after clicks on them, one a group: the same again means by selection."""
    asked = clicks.select("group_id", F.col("disposition").alias("_new"))
    both = dispositions.join(asked, "group_id", "full")
    same = F.coalesce(F.col("disposition") == F.col("_new"), F.lit(False))
    return both.select("group_id", F.when(F.col("_new").isNull(), F.col("disposition")).when(same, "bySelection").otherwise(F.col("_new")).alias("disposition"))


def reset_decisions(members: DataFrame) -> DataFrame:
    """All groups as recommended again: members of `groups_and_members` without any decision."""
    return apply_decisions(members)


def reclaimable(decided: DataFrame) -> DataFrame:
    """Bytes and files to be freed per group."""
    return decided.groupBy("group_id").agg(F.coalesce(F.sum(F.when(F.col("is_redundant"), F.col("file_size"))), F.lit(0)).alias("reclaimable_bytes"), F.count_if("is_redundant").alias("redundant_files"), F.min("disposition").alias("disposition"))


def summary(groups: DataFrame, decided: DataFrame) -> DataFrame:
    """One row over all groups."""
    rows = groups.join(reclaimable(decided), "group_id")
    by_kind = [F.count_if(F.col("dup_kind") == k).alias(n) for k, n in (("exact", "exact_groups"), ("similarImage", "similar_image_groups"), ("similarVideo", "similar_video_groups"))]
    by_choice = [F.count_if(F.col("disposition") == k).alias(n) for k, n in (("keepAll", "keep_all_groups"), ("discardAll", "discard_all_groups"))]
    return rows.agg(F.count("*").alias("group_count"), *by_kind, *by_choice, F.coalesce(F.sum("redundant_files"), F.lit(0)).alias("redundant_files"), F.coalesce(F.sum("reclaimable_bytes"), F.lit(0)).alias("reclaimable_bytes"))


def report(groups: DataFrame, decided: DataFrame) -> DataFrame:
    """Groups in the order of bytes to be freed, members, first path: one row a member."""
    first = decided.groupBy("group_id").agg(F.min_by("path", "member_rank").alias("first_path"))
    head = groups.join(reclaimable(decided).select("group_id", "reclaimable_bytes"), "group_id").join(first, "group_id")
    return head.join(decided.select("group_id", "item_id", "member_rank", "is_keep", "path"), "group_id").orderBy(F.desc("reclaimable_bytes"), F.desc("member_count"), "first_path", "group_id", "member_rank")


def roles(items: DataFrame, groups: DataFrame, decided: DataFrame) -> DataFrame:
    """Every item with the kind of its group, whether it is redundant, and the group's disposition (nulls outside groups)."""
    mine = decided.join(groups.select("group_id", "dup_kind"), "group_id").select("item_id", "group_id", "dup_kind", "is_redundant", "disposition")
    return items.join(mine, "item_id", "left")


def prune(groups: DataFrame, members: DataFrame, alive: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Groups and members after items are gone: `alive` (item_id) stay; groups under two go; the first left is kept where none is."""
    left = members.join(alive.select("item_id"), "item_id", "left_semi")
    counts = left.groupBy("group_id").agg(F.count("*").alias("member_count")).filter("member_count > 1")
    left = _one_kept(left.join(counts.select("group_id"), "group_id", "left_semi"))
    return groups.drop("member_count").join(counts, "group_id"), left
