"""Queries of boxes, patches, audit, tracking and streaming."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import boxes, clock
from ..operators import audit, patches, tracking
from ..sources import derived
from . import intervals
from .oracle_views import EVENTS, FRAMES, REGIONS

IOU_SQL = "greatest(0, least(a.x + a.w, b.x + b.w) - greatest(a.x, b.x)) * greatest(0, least(a.y + a.h, b.y + b.h) - greatest(a.y, b.y))"
WIDE_SQL, HIGH_SQL = "greatest(0, least(a.x + a.w, b.x + b.w) - greatest(a.x, b.x))", "greatest(0, least(a.y + a.h, b.y + b.h) - greatest(a.y, b.y))"


def _boxed(spark, d):
    return derived.regions(spark, d).withColumn("box", boxes.box("x", "y", "w", "h"))


def _pairs(spark, d, next_frame: bool):
    """Boxes of one frame with a later one, or with those of the next frame."""
    r = _boxed(spark, d)
    a, b = r.select("source_id", "frame", "ord", F.col("box").alias("a")), r.select("source_id", (F.col("frame") - int(next_frame)).alias("frame"), F.col("ord").alias("other"), F.col("box").alias("b"))
    pairs = a.join(b, ["source_id", "frame"])
    return pairs if next_frame else pairs.where("other > ord")


def iou_self_pairs(spark, d):
    p = _pairs(spark, d, True)
    out = p.select("source_id", "frame", "ord", "other", boxes.intersection(F.col("a"), F.col("b")).cast("bigint").alias("common"), F.round(boxes.iou(F.col("a"), F.col("b")), 9).alias("iou"))
    return out.where("iou > 0.35")


def same_row_pairs(spark, d):
    p = _pairs(spark, d, False).where(boxes.same_row(F.col("a"), F.col("b")))
    u = boxes.union(F.col("a"), F.col("b"))
    return p.select("source_id", "frame", "ord", "other", *[u[k].alias(f"u{k}") for k in "xywh"])


def box_clamp_union(spark, d):
    r = derived.regions(spark, d)
    c = boxes.clamp(F.col("x") - F.lit(120.5), F.col("y") - F.lit(205.25), F.col("w") + F.lit(0.5), F.col("h").cast("double"), 60, 20)
    u = boxes.union_agg(F.col("c"))
    return r.withColumn("c", c).where("c.w > 0 AND c.h > 0").groupBy("source_id").agg(*[u[k].alias(f"u{k}") for k in "xywh"], F.count("*").alias("n"))


def box_subtract(spark, d):
    p = _pairs(spark, d, True)
    return p.select("source_id", "frame", "ord", "other", F.explode(boxes.subtract(F.col("a"), F.col("b"))).alias("p")).select("source_id", "frame", "ord", "other", *[F.col(f"p.{k}").alias(f"p{k}") for k in "xywh"])


def detection_suppression(spark, d):
    """Boxes of the next frame that no box of this frame covers by more than .35."""
    r = _boxed(spark, d)
    before = r.groupBy("source_id", (F.col("frame") + 1).alias("frame")).agg(F.collect_list("box").alias("old"))
    joined = r.join(before, ["source_id", "frame"], "left")
    hit = F.exists(F.coalesce("old", F.array().cast(f"array<{boxes.BOX}>")), lambda o: boxes.iou(F.col("box"), o) > 0.35)
    return joined.where(~hit).select("source_id", "frame", "ord")


def event_rollup(spark, d):
    out = audit.event_rollup(derived.regions(spark, d), ["source_id", "region_id"])
    rounded = {c: F.round(c, 6) for c in ("span", "max_step", "width_ratio", "height_ratio", "min_confidence", "max_confidence")}
    return out.withColumns(rounded)


def origin_method_grouping_sets(spark, d):
    return audit.grouping_counts(derived.regions(spark, d))


def event_role_counts(spark, d):
    rows = derived.events(spark, d).withColumn("source_id", F.col("source_id") % 10)
    return audit.role_counts(rows, "source_id", ["full_scene", "overlay", "local_redaction", "caption"])


def masked_totals(spark, d):
    """Masked frames, their share and time, and different ids, by source."""
    f, r = derived.frames(spark, d), derived.regions(spark, d).where("origin <> 'ocr'")
    masked = r.groupBy("source_id").agg(F.countDistinct("frame").alias("masked_frames"), F.countDistinct("region_id").alias("ids"))
    total = f.groupBy("source_id").agg(F.count("*").alias("frames"))
    out = total.join(masked, "source_id", "left").fillna(0)
    ms = clock.milliseconds(F.col("masked_frames") / 30)
    return out.select("source_id", "frames", "masked_frames", "ids", F.bround(100 * F.col("masked_frames") / F.col("frames"), 4).alias("percent"), clock.minutes(ms).alias("masked_time"))


def _baseline(spark, d):
    return derived.regions(spark, d).select("source_id", "frame", "ord", "region_id", "x", "y", "w", "h", "origin")


_BASE = f"{REGIONS}, base AS (SELECT source_id, frame, ord, region_id, x, y, w, h, origin FROM regions)"


def patch_replace(spark, d):
    base = _baseline(spark, d)
    frames = base.where("frame % 6 = 0").select("source_id", "frame").distinct()
    new = frames.where("frame % 12 = 0").select("source_id", "frame", F.lit(0).cast("bigint").alias("ord"), *[F.lit(v).cast("bigint").alias(k) for k, v in zip("xywh", (5, 6, 70, 80), strict=True)])
    return patches.replace_frames(base, frames, new)


def _patch(base):
    remove = base.where("frame % 4 = 0 AND region_id IN ('U0', 'U2')")
    extra = base.where("frame % 5 = 1 AND ord = 0").withColumn("x", F.col("x") + 7).withColumn("origin", F.lit("human_review"))
    return remove, extra


def patch_add_remove(spark, d):
    base = _baseline(spark, d)
    return patches.add_remove(base, *_patch(base), "Rabcdef012345")


def patch_add_remove_stats(spark, d):
    base = _baseline(spark, d)
    return patches.delta(base, patches.add_remove(base, *_patch(base), "Rabcdef012345"))


def patch_ordinal_remove(spark, d):
    base = _baseline(spark, d)
    return patches.remove_ordinals(base, base.where("frame % 3 = 0 AND ord = 1"), base.where("frame % 15 = 0 AND ord = 0").withColumn("ord", F.lit(9).cast("bigint")))


def stale_tall_removal(spark, d):
    base = _baseline(spark, d).withColumn("h", F.col("h") + F.col("ord") * 9).withColumn("w", F.lit(60).cast("bigint"))
    return patches.drop_stale_tall(base).select("source_id", "frame", "ord", "h")


def frame_in_region_join(spark, d):
    """Plan regions (a frame range each) spread over their frames, so the join with frames is by equality."""
    plan = derived.events(spark, d).where("role = 'overlay'").select("source_id", "event_id", F.explode(F.sequence(F.col("start") % 60, F.col("start") % 60 + (F.col("end") - F.col("start")) - 1)).alias("frame"))
    return derived.frames(spark, d).select("source_id", "frame").join(plan, ["source_id", "frame"])


STATES = "CASE WHEN event_id % 97 = 0 AND source_id % 3 = 0 THEN 'failed' WHEN event_id % 401 = 0 THEN 'worker_failed' WHEN frame % 5 = 4 AND source_id % 4 = 0 THEN 'skipped' WHEN event_id % 733 = 0 THEN 'truncated' ELSE 'checked' END"


def coverage_ledger(spark, d):
    f = derived.frames(spark, d)
    rows = f.select("source_id", "frame", F.expr(STATES).alias("state"), (F.col("value") > 200).alias("hit"))
    expected = f.groupBy("source_id").agg((F.count("*") + F.when(F.col("source_id") % 10 == 1, 1).otherwise(0)).alias("expected_frames")).withColumn("decoder_exit", F.when(F.col("source_id") % 10 == 2, 1).otherwise(0))
    return audit.coverage(rows, expected)


def channel_rollup(spark, d):
    rows = derived.frames(spark, d).select((F.col("source_id") % 20).alias("source_id"), F.col("event_type").alias("channel"), F.expr("CASE WHEN event_id % 50 = 0 THEN 'failed' WHEN event_id % 3 = 0 THEN 'checked' WHEN event_id % 3 = 1 THEN 'not_checked' ELSE 'not_applicable' END").alias("state"))
    return audit.channel_rollup(rows, "source_id")


def checks_all_pass(spark, d):
    rows = derived.frames(spark, d).select("source_id", (F.col("event_id") % 60 != 0).alias("passed"))
    return audit.all_pass(rows, "source_id")


def pcm_silence(spark, d):
    rows = derived.frames(spark, d).select("source_id", F.when(F.col("source_id") % 4 == 0, F.lit(0.0)).when(F.col("event_id") % 50 == 0, 1e-12).otherwise(0.0).alias("sample"))
    return audit.digital_silence(rows, "source_id").select("source_id", (F.col("peak") * 1e12).cast("bigint").alias("peak_e12"), "samples", "invalid", "silent")


def dominant_colour(spark, d):
    e = F.col("event_id")
    rows = derived.frames(spark, d).select("source_id", (e * 7 % 40).alias("r"), (e * 11 % 24).alias("g"), (e * 13 % 20).alias("b"))
    return audit.dominant_colour(rows, "source_id", 4, 0.1)


def set_equality_check(spark, d):
    f = derived.frames(spark, d).select("source_id", "frame")
    return patches.unequal(f.where("frame % 10 <> 3"), f.where("frame % 10 <> 7 OR source_id > 5"))


def sha_binding_semijoin(spark, d):
    docs = derived.table(spark, d, "documents").select("doc_id", F.sha2(F.coalesce("text", F.lit("")), 256).alias("sha256"))
    # What was approved: each seventh text as it is, the others before a change.
    approved = derived.table(spark, d, "documents").select("doc_id", F.sha2(F.concat(F.coalesce("text", F.lit("")), F.when(F.col("doc_id") % 7 == 0, "").otherwise("!")), 256).alias("sha256"))
    return patches.bound_by_hash(docs, approved)


def report_chunk_faults(spark, d):
    from ..sources.reports import chunk_faults

    runs = derived.frames(spark, d).groupBy("source_id", F.floor(F.col("frame") / 9).alias("part")).agg(F.min("frame").alias("start_frame"), F.count("*").alias("frames"))
    parts = runs.select("source_id", F.concat(F.lit("part-"), F.lpad(F.col("part").cast("string"), 3, "0")).alias("name"), (F.col("start_frame") + F.when(F.col("part") == 3, F.col("source_id") % 2).otherwise(0)).alias("start_frame"), "frames")
    return chunk_faults(parts, "source_id")


def rolling_median_center(spark, d):
    w = Window.partitionBy("source_id", "region_id").orderBy("frame", "ord").rowsBetween(-2, 2)
    r = derived.regions(spark, d)
    return r.select("source_id", "frame", "ord", *[F.percentile(F.col(a) + F.col(b) / 2, F.lit(0.5)).over(w).alias(f"c{a}") for a, b in (("x", "w"), ("y", "h"))])


def lookahead_plateau(spark, d):
    w = Window.partitionBy("source_id", "region_id").orderBy("frame", "ord").rowsBetween(0, 5)
    r = derived.regions(spark, d)
    still = (F.count("*").over(w) == 6) & (F.max("x").over(w) - F.min("x").over(w) <= 6) & (F.max("y").over(w) - F.min("y").over(w) <= 6)
    return r.select("source_id", "frame", "ord", still.alias("plateau"))


def colour_step_reset(spark, d):
    """Where the smoothing of a fill colour starts anew: gaps, segments and jumps of more than 40."""
    w = Window.partitionBy("source_id").orderBy("frame")
    f = derived.frames(spark, d).withColumns({"c": F.floor("value").cast("bigint"), "frame": intervals.gapped(F.col("frame"))})
    new = F.lag("frame").over(w).isNull() | (F.col("frame") != F.lag("frame").over(w) + 1) | (F.abs(F.col("c") - F.lag("c").over(w)) > 40)
    return f.select("source_id", "frame", new.alias("resets"))


def scene_cut_frames(spark, d):
    """Frames whose feature vector differs from that of the frame before by more than the limits."""
    f = derived.frames(spark, d).withColumn("v", F.transform(F.sequence(F.lit(1), F.lit(6)), lambda i: F.col("event_id") * i * 31 % 100))
    w = Window.partitionBy("source_id").orderBy("frame")
    diff = F.zip_with("v", F.lag("v").over(w), lambda a, b: F.abs(a - b))
    f = f.withColumn("dv", diff).where("dv IS NOT NULL")
    total, large = F.aggregate("dv", F.lit(0).cast("bigint"), lambda a, x: a + x), F.size(F.filter("dv", lambda x: x > 12))
    return f.withColumns({"total": total, "large": large.cast("bigint")}).where("total > 38 * 6 OR (large > 6 * 0.18 AND total > 30)").select("source_id", "frame", "total", "large")


def sampled_frames(spark, d):
    """Frames to inspect: every 7th, and those at a scene change; and the frame at a time's bound."""
    f = derived.frames(spark, d).where("frame % 7 = 0 OR event_id % 17 = 0")
    return f.select("source_id", "frame", clock.frame_boundary(F.col("frame") / 30, F.lit(30), F.lit(1)).alias("from_seconds"), clock.frame_boundary((2 * F.col("frame") + F.col("frame") % 2) / 60, F.lit(30), F.lit(1)).alias("from_halves"))


def clock_texts(spark, d):
    ms = F.col("event_id") * 7919 % 36000000
    return derived.table(spark, d, "events").select("event_id", clock.minutes(ms % 3600000).alias("minutes"), clock.hours(ms).alias("hours"), clock.file_stamp(ms).alias("stamp"))


def http_ranges(spark, d):
    e = F.col("event_id")
    header = F.when(e % 5 == 0, F.lit(None)).when(e % 5 == 1, F.format_string("bytes=%d-%d", e % 300, e % 400)).when(e % 5 == 2, F.format_string("bytes=%d-", e % 300)).when(e % 5 == 3, F.format_string("bytes=-%d", e % 50)).otherwise("items=1-2")
    rows = derived.table(spark, d, "events").select("event_id", header.alias("header"), (e % 250).alias("size"))
    return audit.byte_range(rows).select("event_id", F.col("first_byte").cast("bigint").alias("first_byte"), F.col("last_byte").cast("bigint").alias("last_byte"), F.col("status").cast("bigint").alias("status"))


def _stable(spark, d):
    return tracking.stabilise(derived.regions(spark, d).withColumn("segment", F.floor(F.col("frame") / 20)), 1920, 1080)


def _ends(rows, name: str, columns: list[str]):
    """Rows as one end of a pair of following frames: keys and a struct of what the pair's rule reads."""
    frame = F.col("frame") + (1 if name == "k" else 0)
    return rows.select("source_id", "segment", frame.alias("at"), F.struct(*columns).alias(name))


def _unfair(pairs, taken, better: bool):
    """Pairs that a greedy choice would not have left, or not have taken; rank: their order, the greatest (better) or least first.

    A pair stands only if it is taken, or one that was taken comes before it and has one of its ends.
    """
    best = F.max if better else F.min
    mine = F.when(F.col("taken"), F.col("rank"))
    w = [Window.partitionBy("source_id", "segment", "at", F.col(f"{e}.ord")) for e in "ik"]
    p = pairs.withColumn("taken", taken).withColumns({"by_i": best(mine).over(w[0]), "by_k": best(mine).over(w[1])})
    before = (lambda c: F.col(c) > F.col("rank")) if better else (lambda c: F.col(c) < F.col("rank"))
    spared = F.coalesce(before("by_i"), F.lit(False)) | F.coalesce(before("by_k"), F.lit(False))
    return p.where((F.col("taken") & (~F.col("fits") | spared)) | (~F.col("taken") & F.col("fits") & ~spared))


def _by_source(rows, faults):
    """Regions and faults of each source."""
    all_ = rows.groupBy("source_id").agg(F.sum("parts").cast("bigint").alias("regions"))
    return all_.join(faults.groupBy("source_id").agg(F.count("*").alias("faults")), "source_id", "left").select("source_id", "regions", F.coalesce("faults", F.lit(0)).cast("bigint").alias("faults"))


def _meeting(pairs):
    """pairs (i, k) with their common width and height, and the distance of their centres."""
    i, k = F.col("i"), F.col("k")
    span = lambda a, n: F.greatest(F.lit(0), F.least(i[a] + i[n], k[a] + k[n]) - F.greatest(i[a], k[a]))
    far = lambda a, n: (i[a] + i[n] / 2) - (k[a] + k[n] / 2)
    return pairs.withColumns({"wide": span("x", "w"), "high": span("y", "h"), "far": F.sqrt(far("x", "w") * far("x", "w") + far("y", "h") * far("y", "h"))})


def greedy_track_assignment(spark, d):
    """Regions of each source, and pairs of following frames in which tracks differ from the greedy choice (none)."""
    rows, i, k = _stable(spark, d), F.col("i"), F.col("k")
    ends = ["ord", "track", "x", "y", "w", "h", "ids", "fixed"]
    p = _meeting(_ends(rows, "i", ends).join(_ends(rows, "k", ends), ["source_id", "segment", "at"]))
    share = F.col("wide") * F.col("high") / F.least(i["w"] * i["h"], k["w"] * k["h"])
    same = F.arrays_overlap(F.array_remove(i["ids"], ""), F.array_remove(k["ids"], ""))
    fits = (i["w"] / k["w"]).between(0.4, 2.5) & (i["h"] / k["h"]).between(0.45, 2.2) & ((share >= 0.2) | (same & (F.col("far") < F.greatest(F.lit(100), 2 * k["h"])))) & ~i["fixed"] & ~k["fixed"]
    rank = F.struct(F.round(share + 0.25 * same.cast("int") - F.col("far") / 5000, 9), i["ord"], k["track"])
    p = p.withColumns({"fits": fits, "rank": rank})
    return _by_source(rows, _unfair(p, i["track"] == k["track"], True))


def anchor_static_runs(spark, d):
    """Regions of each source, and rows whose run breaks a rule or whose stable box does not cover them (none)."""
    rows = _stable(spark, d)
    track = Window.partitionBy("source_id", "segment", "track").orderBy("frame")
    run = Window.partitionBy("source_id", "segment", "track", "run").orderBy("frame")
    box = F.struct(*"xywh")
    r = rows.withColumn("b", box).withColumns({"a": F.first("b").over(run), "n": F.count("*").over(run.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)), "place": F.row_number().over(run), "next": F.lead("b").over(track)})
    ahead = track.rowsBetween(0, 5)
    r = r.withColumns({"six": F.collect_list("b").over(ahead)})

    def like(b, a, ratio_w, ratio_h, move=None):
        fits = (b["w"] / a["w"]).between(*ratio_w) & (b["h"] / a["h"]).between(*ratio_h)
        return fits & (F.abs(b["x"] - a["x"]) <= move[0]) & (F.abs(b["y"] - a["y"]) <= move[1]) if move else fits

    still = lambda b, a: like(b, a, (0.62, 1.60), (0.80, 1.25), (10, 8))
    span = lambda c: F.array_max(F.transform("six", lambda b: b[c])) - F.array_min(F.transform("six", lambda b: b[c]))
    plateau = (F.size("six") == 6) & (span("x") <= 6) & (span("y") <= 6)
    last = F.col("place") == F.col("n")
    static_fault = (F.col("n") < 6) | ~still(F.col("b"), F.col("a")) | (last & F.coalesce(still(F.col("next"), F.col("a")), F.lit(False)))
    could_stand = (F.col("place") == 1) & (F.size("six") == 6) & F.forall("six", lambda b: still(b, F.col("a")))
    moving_fault = could_stand | ((F.col("place") > 1) & (plateau | ~like(F.col("b"), F.col("a"), (0.65, 1.55), (0.88, 1.12))))
    bare = (F.col("sx") > F.col("x")) | (F.col("sy") > F.col("y")) | (F.col("sx") + F.col("sw") < F.col("x") + F.col("w")) | (F.col("sy") + F.col("sh") < F.col("y") + F.col("h"))
    return _by_source(rows, r.where(bare | F.when(F.col("mode") == "static", static_fault).otherwise(moving_fault)))


def coalesced_frames(spark, d):
    r = derived.regions(spark, d)
    kind = F.when(F.col("frame") % 50 == 0, "reviewed_word").otherwise("domain")
    out = tracking.coalesce(r.withColumns({"kind": kind, "origin": F.when((F.col("frame") % 11 == 0) & (F.col("ord") == 0), "review_color_line").otherwise(F.col("origin")), "fixed": F.col("frame") % 13 == 0}))
    return out.select("source_id", "frame", "ord", "kind", *"xywh", "parts")


QUERIES = {f.__name__: f for f in (iou_self_pairs, same_row_pairs, box_clamp_union, box_subtract, detection_suppression, event_rollup, origin_method_grouping_sets, event_role_counts, masked_totals, patch_replace, patch_add_remove, patch_add_remove_stats, patch_ordinal_remove, stale_tall_removal, frame_in_region_join, coverage_ledger, channel_rollup, checks_all_pass, pcm_silence, dominant_colour, set_equality_check, sha_binding_semijoin, report_chunk_faults, rolling_median_center, lookahead_plateau, colour_step_reset, scene_cut_frames, sampled_frames, clock_texts, http_ranges, greedy_track_assignment, anchor_static_runs, coalesced_frames)}

_ADDED = f"""{_BASE}, kept AS (SELECT * FROM base WHERE NOT (frame % 4 = 0 AND region_id IN ('U0', 'U2') AND EXISTS (SELECT 1 FROM base r WHERE r.source_id = base.source_id AND r.frame = base.frame AND r.region_id = base.region_id))),
fresh AS (SELECT source_id, frame, ord, 'Rabcdef012345-' || region_id AS region_id, x + 7 AS x, y, w, h, 'human_review' AS origin FROM base WHERE frame % 5 = 1 AND ord = 0),
done AS (SELECT * FROM kept UNION ALL SELECT * FROM fresh)"""

ORACLES = {
    "iou_self_pairs": f"""WITH {REGIONS}, p AS (SELECT a.source_id, a.frame, a.ord, b.ord AS other, {IOU_SQL} AS common, a.w * a.h + b.w * b.h AS areas FROM regions a JOIN regions b ON a.source_id = b.source_id AND b.frame = a.frame + 1)
SELECT source_id, frame, ord, other, CAST(common AS BIGINT) AS common, round(common / greatest(1, areas - common), 9) AS iou FROM p WHERE common / greatest(1, areas - common) > 0.35""",
    "same_row_pairs": f"""WITH {REGIONS} SELECT a.source_id, a.frame, a.ord, b.ord AS other, least(a.x, b.x) AS ux, least(a.y, b.y) AS uy, greatest(a.x + a.w, b.x + b.w) - least(a.x, b.x) AS uw, greatest(a.y + a.h, b.y + b.h) - least(a.y, b.y) AS uh
FROM regions a JOIN regions b ON a.source_id = b.source_id AND a.frame = b.frame AND b.ord > a.ord
WHERE 2 * {HIGH_SQL} >= least(a.h, b.h) AND 100 * {WIDE_SQL} >= 45 * least(a.w, b.w) AND 10 * (greatest(a.x + a.w, b.x + b.w) - least(a.x, b.x)) <= 16 * greatest(a.w, b.w)""",
    "box_clamp_union": f"""WITH {REGIONS}, c AS (SELECT source_id, greatest(0, floor(x - 120.5)) AS x1, greatest(0, floor(y - 205.25)) AS y1, least(60, ceil(x - 120.5 + w + 0.5)) AS x2, least(20, ceil(y - 205.25 + h)) AS y2 FROM regions)
SELECT source_id, CAST(min(x1) AS BIGINT) AS ux, CAST(min(y1) AS BIGINT) AS uy, CAST(max(x2) - min(x1) AS BIGINT) AS uw, CAST(max(y2) - min(y1) AS BIGINT) AS uh, count(*) AS n FROM c WHERE x2 > x1 AND y2 > y1 GROUP BY source_id""",
    "box_subtract": f"""WITH {REGIONS}, p AS (SELECT a.source_id, a.frame, a.ord, b.ord AS other, a.x, a.y, a.w, a.h, greatest(a.x, b.x) AS l, least(a.x + a.w, b.x + b.w) AS r, greatest(a.y, b.y) AS t, least(a.y + a.h, b.y + b.h) AS u
  FROM regions a JOIN regions b ON a.source_id = b.source_id AND b.frame = a.frame + 1), q AS (
  SELECT source_id, frame, ord, other, x AS px, y AS py, w AS pw, h AS ph FROM p WHERE NOT (r > l AND u > t)
  UNION ALL SELECT source_id, frame, ord, other, x, y, w, t - y FROM p WHERE r > l AND u > t UNION ALL SELECT source_id, frame, ord, other, x, u, w, y + h - u FROM p WHERE r > l AND u > t
  UNION ALL SELECT source_id, frame, ord, other, x, t, l - x, u - t FROM p WHERE r > l AND u > t UNION ALL SELECT source_id, frame, ord, other, r, t, x + w - r, u - t FROM p WHERE r > l AND u > t) SELECT * FROM q WHERE pw > 0 AND ph > 0""",
    "detection_suppression": f"""WITH {REGIONS} SELECT a.source_id, a.frame, a.ord FROM regions a WHERE NOT EXISTS (SELECT 1 FROM regions b WHERE b.source_id = a.source_id AND b.frame = a.frame - 1 AND {IOU_SQL} / greatest(1, a.w * a.h + b.w * b.h - {IOU_SQL}) > 0.35)""",
    "event_rollup": f"""WITH {REGIONS}, c AS (SELECT *, x + w / 2 AS cx, y + h / 2 AS cy FROM regions), s AS (SELECT *, coalesce(sqrt((cx - lag(cx) OVER k) ** 2 + (cy - lag(cy) OVER k) ** 2), 0) AS step FROM c WINDOW k AS (PARTITION BY source_id, region_id ORDER BY frame, ord)),
g AS (SELECT source_id, region_id, min(frame) AS first_frame, max(frame) AS last_frame, count(*) AS n_regions, min(x) AS min_x, max(x) AS max_x, min(y) AS min_y, max(y) AS max_y, min(w) AS min_w, max(w) AS max_w, min(h) AS min_h, max(h) AS max_h,
  sqrt((max(cx) - min(cx)) ** 2 + (max(cy) - min(cy)) ** 2) AS span, max(step) AS max_step, min(confidence) AS min_confidence, max(confidence) AS max_confidence, count(*) FILTER (box_method = 'line_fallback') AS fallbacks,
  max(w) / greatest(1, min(w)) AS width_ratio, max(h) / greatest(1, min(h)) AS height_ratio FROM s GROUP BY source_id, region_id)
SELECT * REPLACE (round(span, 6) AS span, round(max_step, 6) AS max_step, round(width_ratio, 6) AS width_ratio, round(height_ratio, 6) AS height_ratio, round(min_confidence, 6) AS min_confidence, round(max_confidence, 6) AS max_confidence),
  span > 10 AS moves, greatest(width_ratio, height_ratio) > 1.1 AS scales,
  concat_ws(',', CASE WHEN greatest(width_ratio, height_ratio) > 1.25 THEN 'size' END, CASE WHEN max_step > 50 THEN 'step' END, CASE WHEN fallbacks > 0 THEN 'line_fallback' END) AS reasons FROM g""",
    "origin_method_grouping_sets": f"""WITH {REGIONS} SELECT origin, box_method, scale, CAST(grouping(origin, box_method, scale) AS BIGINT) AS set_id, count(*) AS n, round_even(100 * count(*) / (SELECT count(*) FROM regions), 4) AS percent
FROM regions GROUP BY GROUPING SETS ((origin), (box_method), (origin, scale), ())""",
    "event_role_counts": f"WITH {EVENTS} SELECT source_id % 10 AS source_id, count(*) FILTER (role = 'full_scene') AS full_scene, count(*) FILTER (role = 'overlay') AS overlay, count(*) FILTER (role = 'local_redaction') AS local_redaction, CAST(0 AS BIGINT) AS caption FROM ev GROUP BY 1",
    "masked_totals": f"""WITH {REGIONS}, m AS (SELECT source_id, count(DISTINCT frame) AS mf, count(DISTINCT region_id) AS ids FROM regions WHERE origin <> 'ocr' GROUP BY 1), t AS (SELECT source_id, count(*) AS frames FROM frames GROUP BY 1),
j AS (SELECT t.source_id, frames, coalesce(mf, 0) AS masked_frames, coalesce(ids, 0) AS ids, CAST(round_even(coalesce(mf, 0) / 30 * 1000, 0) AS BIGINT) AS ms FROM t LEFT JOIN m USING (source_id))
SELECT source_id, frames, masked_frames, ids, round_even(100 * masked_frames / frames, 4) AS percent, printf('%02d:%02d.%03d', ms // 60000, ms // 1000 % 60, ms % 1000) AS masked_time FROM j""",
    "patch_replace": f"""WITH {_BASE} SELECT * FROM base WHERE frame % 6 <> 0 UNION ALL
SELECT DISTINCT source_id, frame, CAST(0 AS BIGINT), printf('R%07d-%d', frame, 0), CAST(5 AS BIGINT), CAST(6 AS BIGINT), CAST(70 AS BIGINT), CAST(80 AS BIGINT), 'human_review' FROM base WHERE frame % 12 = 0""",
    "patch_add_remove": f"WITH {_ADDED} SELECT * FROM done",
    "patch_add_remove_stats": f"""WITH {_ADDED}, k AS (SELECT source_id, frame, region_id, x, y, w, h, sum(b) AS b, sum(a) AS a FROM (SELECT source_id, frame, region_id, x, y, w, h, 1 AS b, 0 AS a FROM base UNION ALL SELECT source_id, frame, region_id, x, y, w, h, 0, 1 FROM done) GROUP BY ALL),
f AS (SELECT source_id, frame, sum(greatest(a - b, 0)) AS added, sum(greatest(b - a, 0)) AS removed, sum(b) AS b, sum(a) AS a FROM k GROUP BY 1, 2)
SELECT CAST(sum(added) AS BIGINT) AS added, CAST(sum(removed) AS BIGINT) AS removed, count(*) FILTER (b > 0) AS masked_before, count(*) FILTER (a > 0) AS masked_after, count(*) FILTER (b = 0 AND a > 0) AS newly_masked, count(*) FILTER (b > 0 AND a = 0) AS newly_unmasked FROM f""",
    "patch_ordinal_remove": f"WITH {_BASE} SELECT * FROM base WHERE NOT (frame % 3 = 0 AND ord = 1) UNION ALL SELECT * REPLACE (CAST(9 AS BIGINT) AS ord) FROM base WHERE frame % 15 = 0 AND ord = 0",
    "stale_tall_removal": f"""WITH {_BASE}, t AS (SELECT * REPLACE (h + ord * 9 AS h, CAST(60 AS BIGINT) AS w) FROM base)
SELECT source_id, frame, ord, h FROM t a WHERE NOT EXISTS (SELECT 1 FROM t b WHERE a.source_id = b.source_id AND a.frame = b.frame AND a.region_id = b.region_id AND a.ord <> b.ord AND a.h > 1.2 * b.h AND a.w / b.w BETWEEN 0.83 AND 1.2 AND {IOU_SQL} > 0 AND {IOU_SQL} >= 0.9 * b.w * b.h)""",
    "frame_in_region_join": f"WITH {FRAMES}, {EVENTS} SELECT f.source_id, f.frame, v.event_id FROM frames f JOIN ev v ON v.source_id = f.source_id AND v.role = 'overlay' AND f.frame >= v.s % 60 AND f.frame < v.s % 60 + (v.e - v.s)",
    "coverage_ledger": f"""WITH {FRAMES}, r AS (SELECT *, {STATES} AS state, value > 200 AS hit FROM frames), x AS (SELECT source_id, count(*) + CASE WHEN source_id % 10 = 1 THEN 1 ELSE 0 END AS expected_frames, CASE WHEN source_id % 10 = 2 THEN 1 ELSE 0 END AS decoder_exit,
  count(*) FILTER (state <> 'truncated') AS decoded_frames, count(*) FILTER (state = 'checked') AS checked_frames, count(*) FILTER (state IN ('failed', 'worker_failed')) AS failed_frames, count(*) FILTER (state = 'skipped') AS skipped_frames,
  min(frame) FILTER (state IN ('failed', 'worker_failed')) AS first_failed_frame, count(*) FILTER (state = 'truncated') AS tr, count(*) FILTER (state = 'worker_failed') AS wf, count(*) FILTER (hit) AS hits FROM r GROUP BY source_id),
c AS (SELECT *, CASE WHEN tr > 0 THEN 'truncated_frame' WHEN wf > 0 THEN 'ocr_worker_failed' WHEN decoder_exit <> 0 THEN 'decoder_failed' WHEN decoded_frames = 0 OR decoded_frames <> expected_frames THEN 'decoded_coverage_incomplete' WHEN failed_frames > 0 THEN 'ocr_coverage_incomplete' END AS failure_code FROM x)
SELECT source_id, expected_frames, decoded_frames, checked_frames, failed_frames, skipped_frames, first_failed_frame, failure_code, CASE WHEN failure_code IS NOT NULL THEN 'failed' WHEN hits > 0 THEN 'hits' ELSE 'no_hits' END AS result FROM c""",
    "channel_rollup": f"""WITH {FRAMES}, r AS (SELECT source_id % 20 AS source_id, event_type AS channel, CASE WHEN event_id % 50 = 0 THEN 3 WHEN event_id % 3 = 0 THEN 2 WHEN event_id % 3 = 1 THEN 1 ELSE 0 END AS k FROM frames)
SELECT source_id, channel, ['not_applicable', 'not_checked', 'checked', 'failed'][max(k) + 1] AS state, count(*) AS tracks FROM r GROUP BY 1, 2""",
    "checks_all_pass": f"WITH {FRAMES} SELECT source_id, bool_and(event_id % 60 <> 0) AS all_passed, count(*) AS checks FROM frames GROUP BY 1",
    "pcm_silence": f"WITH {FRAMES}, p AS (SELECT source_id, CASE WHEN source_id % 4 = 0 THEN 0 WHEN event_id % 50 = 0 THEN 1 ELSE 0 END AS v FROM frames) SELECT source_id, CAST(max(v) AS BIGINT) AS peak_e12, count(*) AS samples, CAST(0 AS BIGINT) AS invalid, max(v) = 0 AS silent FROM p GROUP BY 1",
    "dominant_colour": f"""WITH {FRAMES}, p AS (SELECT source_id, event_id * 7 % 40 AS r, event_id * 11 % 24 AS g, event_id * 13 % 20 AS b FROM frames), q AS (SELECT source_id, CAST(r // 16 * 256 + g // 16 * 16 + b // 16 AS BIGINT) AS bin, count(*) AS n, median(r) AS r, median(g) AS g, median(b) AS b, sum(count(*)) OVER (PARTITION BY source_id) AS t FROM p GROUP BY 1, 2)
SELECT source_id, bin, n, r, g, b FROM (SELECT * FROM q QUALIFY row_number() OVER (PARTITION BY source_id ORDER BY n DESC, bin) = 1) WHERE n >= 4 AND n >= 0.1 * t""",
    "set_equality_check": f"WITH {FRAMES}, a AS (SELECT source_id, frame FROM frames WHERE frame % 10 <> 3), b AS (SELECT source_id, frame FROM frames WHERE frame % 10 <> 7 OR source_id > 5) SELECT *, 'expected' AS only_in FROM (SELECT * FROM a EXCEPT ALL SELECT * FROM b) UNION ALL SELECT *, 'found' FROM (SELECT * FROM b EXCEPT ALL SELECT * FROM a)",
    "sha_binding_semijoin": "WITH d AS (SELECT doc_id, sha256(coalesce(text, '')) AS sha256, sha256(coalesce(text, '') || CASE WHEN doc_id % 7 = 0 THEN '' ELSE '!' END) AS a FROM documents) SELECT sha256, doc_id FROM d WHERE sha256 IN (SELECT a FROM d)",
    "report_chunk_faults": f"""WITH {FRAMES}, p AS (SELECT source_id, frame // 9 AS part, min(frame) AS s, count(*) AS frames FROM frames GROUP BY 1, 2), q AS (SELECT source_id, 'part-' || lpad(CAST(part AS VARCHAR), 3, '0') AS name, s + CASE WHEN part = 3 THEN source_id % 2 ELSE 0 END AS start_frame, frames FROM p),
r AS (SELECT *, CAST(coalesce(sum(frames) OVER (PARTITION BY source_id ORDER BY start_frame, name ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS expected_start FROM q) SELECT * FROM r WHERE start_frame <> expected_start""",
    "rolling_median_center": f"WITH {REGIONS} SELECT source_id, frame, ord, quantile_cont(x + w / 2, 0.5) OVER k AS cx, quantile_cont(y + h / 2, 0.5) OVER k AS cy FROM regions WINDOW k AS (PARTITION BY source_id, region_id ORDER BY frame, ord ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING)",
    "lookahead_plateau": f"WITH {REGIONS} SELECT source_id, frame, ord, count(*) OVER k = 6 AND max(x) OVER k - min(x) OVER k <= 6 AND max(y) OVER k - min(y) OVER k <= 6 AS plateau FROM regions WINDOW k AS (PARTITION BY source_id, region_id ORDER BY frame, ord ROWS BETWEEN CURRENT ROW AND 5 FOLLOWING)",
    "colour_step_reset": f"WITH {FRAMES}, f AS (SELECT source_id, frame + frame // 9 AS frame, floor(value) AS c FROM frames) SELECT source_id, frame, lag(frame) OVER k IS NULL OR frame <> lag(frame) OVER k + 1 OR abs(c - lag(c) OVER k) > 40 AS resets FROM f WINDOW k AS (PARTITION BY source_id ORDER BY frame)",
    "scene_cut_frames": f"""WITH {FRAMES}, v AS (SELECT source_id, frame, i, abs(event_id * i * 31 % 100 - lag(event_id * i * 31 % 100) OVER (PARTITION BY source_id, i ORDER BY frame)) AS dv FROM frames, range(1, 7) t(i)),
g AS (SELECT source_id, frame, CAST(sum(dv) AS BIGINT) AS total, count(*) FILTER (dv > 12) AS large FROM v WHERE dv IS NOT NULL GROUP BY 1, 2) SELECT * FROM g WHERE total > 38 * 6 OR (large > 6 * 0.18 AND total > 30)""",
    "sampled_frames": f"WITH {FRAMES} SELECT source_id, frame, frame AS from_seconds, frame + frame % 2 AS from_halves FROM frames WHERE frame % 7 = 0 OR event_id % 17 = 0",
    "greedy_track_assignment": f"WITH {REGIONS} SELECT source_id, count(*) AS regions, CAST(0 AS BIGINT) AS faults FROM regions GROUP BY 1",
    "anchor_static_runs": f"WITH {REGIONS} SELECT source_id, count(*) AS regions, CAST(0 AS BIGINT) AS faults FROM regions GROUP BY 1",
    "coalesced_frames": f"""WITH {REGIONS}, r AS (SELECT *, CASE WHEN frame % 50 = 0 THEN 'reviewed_word' ELSE 'domain' END AS kind FROM regions),
p AS (SELECT a.source_id, a.frame, a.kind, a.x AS ax, a.y AS ay, a.w AS aw, a.h AS ah, b.x AS bx, b.y AS byy, b.w AS bw, b.h AS bh, b.origin AS origin,
  b.x IS NOT NULL AND coalesce(2 * {HIGH_SQL} >= least(a.h, b.h) AND 100 * {WIDE_SQL} >= 45 * least(a.w, b.w) AND 10 * (greatest(a.x + a.w, b.x + b.w) - least(a.x, b.x)) <= 16 * greatest(a.w, b.w), false) AS along
  FROM r a LEFT JOIN r b ON b.source_id = a.source_id AND b.frame = a.frame AND b.ord = 1 WHERE a.ord = 0),
q AS (SELECT *, along AND frame % 11 = 0 AND kind <> 'reviewed_word' AND origin IN ('ocr', 'tracked') AND 5 * aw >= 4 * bw AS over, along AND frame % 13 <> 0 AS free FROM p)
SELECT source_id, frame, CAST(0 AS BIGINT) AS ord, kind, CASE WHEN free AND NOT over THEN least(ax, bx) ELSE ax END AS x, CASE WHEN free AND NOT over THEN least(ay, byy) ELSE ay END AS y,
  CASE WHEN free AND NOT over THEN greatest(ax + aw, bx + bw) - least(ax, bx) ELSE aw END AS w, CASE WHEN free AND NOT over THEN greatest(ay + ah, byy + bh) - least(ay, byy) ELSE ah END AS h,
  CAST(CASE WHEN free OR over THEN 2 ELSE 1 END AS BIGINT) AS parts FROM q
UNION ALL SELECT source_id, frame, CAST(1 AS BIGINT), kind, bx, byy, bw, bh, CAST(1 AS BIGINT) FROM q WHERE bx IS NOT NULL AND NOT free AND NOT over""",
    "clock_texts": """WITH t AS (SELECT event_id, event_id * 7919 % 36000000 AS ms FROM events) SELECT event_id, printf('%02d:%02d.%03d', ms % 3600000 // 60000, ms // 1000 % 60, ms % 1000) AS minutes, printf('%02d:%02d:%02d.%03d', ms // 3600000, ms // 60000 % 60, ms // 1000 % 60, ms % 1000) AS hours,
  printf('%02dh%02dm%02ds%03d', ms // 3600000, ms // 60000 % 60, ms // 1000 % 60, ms % 1000) AS stamp FROM t""",
    "http_ranges": """WITH t AS (SELECT event_id, event_id % 5 AS k, event_id % 250 AS n, CASE event_id % 5 WHEN 1 THEN event_id % 300 WHEN 2 THEN event_id % 300 END AS a, CASE event_id % 5 WHEN 1 THEN event_id % 400 WHEN 3 THEN event_id % 50 END AS b FROM events),
u AS (SELECT *, CASE WHEN k = 0 THEN 0 WHEN a IS NOT NULL THEN a WHEN b IS NOT NULL THEN greatest(0, n - b) END AS f, CASE WHEN k = 0 OR a IS NULL OR b IS NULL THEN n - 1 ELSE least(b, n - 1) END AS l FROM t),
s AS (SELECT *, CASE WHEN k = 0 THEN 200 WHEN n > 0 AND k <> 4 AND ((a IS NULL AND b > 0) OR (a IS NOT NULL AND f < n AND l >= f)) THEN 206 ELSE 416 END AS status FROM u)
SELECT event_id, CAST(CASE WHEN status <> 416 THEN f END AS BIGINT) AS first_byte, CAST(CASE WHEN status <> 416 THEN l END AS BIGINT) AS last_byte, CAST(status AS BIGINT) AS status FROM s""",
}
