"""Patch algebra: reviewed rectangles replace, join or leave a baseline of regions.

A region row has source_id, frame, ord, region_id, x, y, w, h and origin. Patches are tables of operations; each
operator is a few anti-joins and a union on the region's key, so a patch of any size works, and applying it twice
changes nothing.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BOX = ["x", "y", "w", "h"]
ROW = ["source_id", "frame", "ord", "region_id", *BOX, "origin"]
FRAME = ["source_id", "frame"]


def replace_frames(base: DataFrame, frames: DataFrame, boxes: DataFrame) -> DataFrame:
    """Frames of the patch lose all they had and get its boxes, none if it has none for them; others stay."""
    kept = base.join(frames.select(*FRAME).distinct(), FRAME, "left_anti").select(*ROW)
    fresh = boxes.join(frames.select(*FRAME).distinct(), FRAME, "left_semi")
    fresh = fresh.withColumn("region_id", F.format_string("R%07d-%d", F.col("frame").cast("bigint"), F.col("ord").cast("bigint"))).withColumn("origin", F.lit("human_review"))
    return kept.unionByName(fresh.select(*ROW))


def add_remove(base: DataFrame, remove_ids: DataFrame, additions: DataFrame, namespace: str) -> DataFrame:
    """Regions without the removed ids, and the additions whose id and box are not there yet; ids get the namespace."""
    kept = base.join(remove_ids.select(*FRAME, "region_id").distinct(), [*FRAME, "region_id"], "left_anti").select(*ROW)
    named = additions.withColumn("region_id", F.concat(F.lit(namespace + "-"), "region_id")).select(*ROW)
    fresh = named.join(kept.select(*FRAME, "region_id", *BOX), [*FRAME, "region_id", *BOX], "left_anti").select(*ROW)
    return kept.unionByName(fresh)


def remove_ordinals(base: DataFrame, ordinals: DataFrame, additions: DataFrame) -> DataFrame:
    """Regions without those at the given places of the baseline, with the additions after them."""
    kept = base.join(ordinals.select(*FRAME, "ord").distinct(), [*FRAME, "ord"], "left_anti").select(*ROW)
    return kept.unionByName(additions.select(*ROW))


def double_patched(ordinals: DataFrame, patch: str = "patch_id") -> DataFrame:
    """Frames on which two patches work; there must be none."""
    return ordinals.groupBy(*FRAME).agg(F.countDistinct(patch).alias("patches")).where("patches > 1")


def delta(before: DataFrame, after: DataFrame) -> DataFrame:
    """One row: regions added and removed, masked frames before and after, frames newly masked and unmasked."""
    key = [*FRAME, "region_id", *BOX]
    sides = before.select(*key, F.lit(1).alias("b"), F.lit(0).alias("a")).unionByName(after.select(*key, F.lit(0).alias("b"), F.lit(1).alias("a")))
    rows = sides.groupBy(*key).agg(F.sum("b").alias("b"), F.sum("a").alias("a"))
    frames = rows.groupBy(*FRAME).agg(
        F.sum(F.greatest(F.col("a") - F.col("b"), F.lit(0))).alias("added"), F.sum(F.greatest(F.col("b") - F.col("a"), F.lit(0))).alias("removed"),
        F.sum("b").alias("b"), F.sum("a").alias("a"),
    )
    count = lambda c: F.count_if(c).cast("bigint")
    return frames.agg(
        F.coalesce(F.sum("added"), F.lit(0)).cast("bigint").alias("added"), F.coalesce(F.sum("removed"), F.lit(0)).cast("bigint").alias("removed"),
        count(F.col("b") > 0).alias("masked_before"), count(F.col("a") > 0).alias("masked_after"),
        count((F.col("b") == 0) & (F.col("a") > 0)).alias("newly_masked"), count((F.col("b") > 0) & (F.col("a") == 0)).alias("newly_unmasked"),
    )


def drop_stale_tall(regions: DataFrame) -> DataFrame:
    """Regions without those that a lower one of the same id in the same frame nearly fills."""
    a, b = regions.alias("a"), regions.alias("b")
    wide = F.least(F.col("a.x") + F.col("a.w"), F.col("b.x") + F.col("b.w")) - F.greatest("a.x", "b.x")
    high = F.least(F.col("a.y") + F.col("a.h"), F.col("b.y") + F.col("b.h")) - F.greatest("a.y", "b.y")
    same = (F.col("a.source_id") == F.col("b.source_id")) & (F.col("a.frame") == F.col("b.frame")) & (F.col("a.region_id") == F.col("b.region_id")) & (F.col("a.ord") != F.col("b.ord"))
    stale = (F.col("a.h") > 1.2 * F.col("b.h")) & (F.col("a.w") / F.col("b.w")).between(0.83, 1.2) & (wide > 0) & (high > 0) & (wide * high >= 0.9 * F.col("b.w") * F.col("b.h"))
    tall = a.join(b, same & stale).select("a.source_id", "a.frame", "a.ord").distinct()
    return regions.join(tall, [*FRAME, "ord"], "left_anti")


def unequal(expected: DataFrame, found: DataFrame) -> DataFrame:
    """Rows that only one side has, named by side: empty if both are the same set."""
    return expected.exceptAll(found).withColumn("only_in", F.lit("expected")).unionByName(found.exceptAll(expected).withColumn("only_in", F.lit("found")))


def bound_by_hash(rows: DataFrame, report: DataFrame, key: str = "sha256") -> DataFrame:
    """Rows of a patch that name a hash of the reports at hand; others must not be applied."""
    return rows.join(report.select(key).distinct(), key, "left_semi")
