"""Putting parts together: chunks of one recording, plans over baselines, findings of several channels, and checks of the whole."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import boxes
from .detection import Policy, detect

# The form of a category, and bounds of the synthetic acceptance.
CATEGORY = "^[a-z][a-z0-9_-]{0,48}$"
LEAST_COVERAGE, MOST_NORMAL, MOST_STALE = 0.98, 0.005, 100
#: Frames that one bucket of an overlap join spans.
BUCKET = 512


def part_id(part: Column, region_id: Column) -> Column:
    """A region's id within its part: equal ids of two parts are not one link."""
    named = F.when(F.coalesce(region_id, F.lit("")) == "", "unidentified").otherwise(region_id)
    return F.concat(F.lit("P"), F.lpad(part.cast("string"), 2, "0"), F.lit(":"), named)


def merge_chunks(parts: DataFrame, regions: DataFrame) -> DataFrame:
    """Regions of all parts on one timeline. parts: source_id, part, start_frame; regions: source_id, part, frame, region_id, ..."""
    placed = regions.join(parts.select("source_id", "part", "start_frame"), ["source_id", "part"])
    return placed.withColumns({"frame": F.col("start_frame") + F.col("frame"), "region_id": part_id(F.col("part"), F.col("region_id"))}).drop("start_frame")


def chunk_errors(parts: DataFrame, frames: DataFrame) -> DataFrame:
    """source_id, part, fault: what keeps the parts from being one recording.

    parts: source_id, part, start_frame, frames, rate, width, height; frames: source_id, part, frame, one row for each
    record. Faults: start (not the frames before it), rate and size (not those of the first part), count, order.
    """
    w = Window.partitionBy("source_id").orderBy("part")
    before = F.coalesce(F.sum("frames").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    first = {c: F.first(c).over(w) for c in ("rate", "width", "height")}
    # Records are 0 to n - 1 if there are n of them, all different, and the greatest is n - 1.
    found = frames.groupBy("source_id", "part").agg(F.count("*").alias("n"), F.countDistinct("frame").alias("different"), F.min("frame").alias("low"), F.max("frame").alias("high"))
    rows = parts.withColumns({"before": before, **{f"first_{c}": x for c, x in first.items()}}).join(found, ["source_id", "part"], "left")
    n = F.coalesce("n", F.lit(0))
    dense = (F.col("different") == n) & (F.col("low") == 0) & (F.col("high") == n - 1)
    rules = {
        "start": F.col("start_frame") != F.col("before"), "rate": F.col("rate") != F.col("first_rate"), "size": (F.col("width") != F.col("first_width")) | (F.col("height") != F.col("first_height")),
        "count": n != F.col("frames"), "order": (n > 0) & ~dense,
    }
    return rows.select("source_id", "part", F.explode(F.array_compact(F.array(*[F.when(c, name) for name, c in rules.items()]))).alias("fault"))


def chunk_cuts(parts: DataFrame, cuts: DataFrame) -> DataFrame:
    """source_id, frame: the cuts of all parts on one timeline, and each part's start but the first's."""
    own = cuts.join(parts.select("source_id", "part", "start_frame"), ["source_id", "part"]).select("source_id", (F.col("start_frame") + F.col("frame")).alias("frame"))
    return own.unionByName(parts.where("part > 0").select("source_id", F.col("start_frame").alias("frame"))).distinct()


def part_totals(parts: DataFrame, regions: DataFrame, origins: list[str]) -> DataFrame:
    """Per part: its frames, those with regions, and regions by origin. regions: source_id, part, frame, origin."""
    counts = [F.count_if(F.col("origin") == o).cast("bigint").alias(o) for o in origins]
    found = regions.groupBy("source_id", "part").agg(F.countDistinct("frame").alias("masked_frames"), *counts)
    return parts.select("source_id", "part", "frames").join(found, ["source_id", "part"], "left").fillna(0)


def containing(points: DataFrame, intervals: DataFrame, key: str, number: str) -> DataFrame:
    """points (key, frame, ...) with the number of the interval [start, end) that holds each; null in between.

    Intervals of a key are apart, so the last that starts at or before a point is the only one that may hold it: one
    sort, no range join.
    """
    rows = points.withColumns({"__side": F.lit(1), "__at": F.col("frame").cast("bigint")})
    starts = intervals.select(key, F.col("start").cast("bigint").alias("__at"), F.lit(0).alias("__side"), F.struct(F.col(number).alias("n"), F.col("end").alias("end")).alias("__i"))
    w = Window.partitionBy(key).orderBy("__at", "__side").rowsBetween(Window.unboundedPreceding, 0)
    both = rows.unionByName(starts, allowMissingColumns=True).withColumn("__i", F.last("__i", ignorenulls=True).over(w)).where("__side = 1")
    return both.withColumn(number, F.when(F.col("frame") < F.col("__i.end"), F.col("__i.n"))).drop("__side", "__at", "__i")


def overlapping(events: DataFrame, windows: DataFrame, key: str) -> DataFrame:
    """Pairs of events and windows (key, start, end, ...) that overlap, by buckets; a pair meets once, where the later begins."""
    def dealt(df: DataFrame, name: str) -> DataFrame:
        last = F.greatest(F.col("start"), F.col("end") - 1)
        return df.select(key, F.explode(F.sequence(F.floor(F.col("start") / BUCKET), F.floor(last / BUCKET))).alias("bucket"), F.struct(*[c for c in df.columns if c != key]).alias(name))

    met = dealt(events, "event").join(dealt(windows, "window"), [key, "bucket"])
    low = F.greatest("event.start", "window.start")
    return met.where((F.col("event.start") < F.col("window.end")) & (F.col("event.end") > F.col("window.start")) & (F.floor(low / BUCKET) == F.col("bucket"))).drop("bucket")


def with_baseline(plan: DataFrame, baseline: DataFrame, first: Column) -> DataFrame:
    """The plan's regions (source_id, region_id, start, end, box columns) and those of the baseline, one frame each.

    baseline: source_id, frame from the baseline's first, ord, x, y, w, h; first: the source frame that it begins with.
    """
    source = (first + F.col("frame")).cast("bigint")
    own = baseline.select("source_id", F.format_string("baseline-%d-%d", source, F.col("ord").cast("bigint")).alias("region_id"), source.alias("start"), (source + 1).alias("end"), *"xywh")
    return plan.select("source_id", "region_id", "start", "end", *"xywh").unionByName(own)


def interval_mismatches(rebuilt: DataFrame, supplied: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """Ordinals at which two lists of intervals differ, or that one of them lacks."""
    a, b = (df.select(key, "ordinal", F.struct(*columns).alias(name)) for df, name in ((rebuilt, "rebuilt"), (supplied, "supplied")))
    return a.join(b, [key, "ordinal"], "full").where(~F.col("rebuilt").eqNullSafe(F.col("supplied"))).select(key, "ordinal", F.col("rebuilt").isNull().alias("only_supplied"), F.col("supplied").isNull().alias("only_rebuilt"))


def code_masks(codes: DataFrame, width: int, height: int, padding: int = 4, privacy: bool = True) -> DataFrame:
    """Machine-readable codes (source_id, frame, box) as masks: under privacy alone, with a certain, empty span."""
    b = F.col("box")
    pixel = boxes.clamp(b["x"] * width - padding, b["y"] * height - padding, b["w"] * width + 2 * padding, b["h"] * height + 2 * padding, width, height)
    said = {"kind": "qr_code", "status": "mask", "reason": "privacy_qr_code", "confidence": 1.0, "start": 0, "end": 0}
    rows = codes.withColumn("pixel_box", pixel).where(F.lit(privacy) & (b["w"] > 0) & (b["h"] > 0) & (F.col("pixel_box.w") > 0) & (F.col("pixel_box.h") > 0))
    return rows.withColumns({c: F.lit(v) for c, v in said.items()})


def event_category(events: DataFrame, role: str = "local_redaction") -> DataFrame:
    """Events of one role, with categories of another form called local."""
    ok = F.coalesce(F.col("category").rlike(CATEGORY), F.lit(False))
    return events.where(F.col("role") == role).withColumn("category", F.when(ok, F.col("category")).otherwise("local"))


def heard(segments: DataFrame, channel: str, text: str = "text") -> DataFrame:
    """What subtitles or speech give to review: nothing that is kept, everything to be listened to, no words or offsets."""
    found = detect(segments, text, Policy(privacy=True, channel=channel))
    rows = found.select("*", F.explode(F.filter("spans", lambda s: s["status"] != "keep")).alias("s")).drop("spans", text)
    return rows.withColumns({"channel": F.lit(channel), "kind": F.col("s.kind"), "status": F.lit("needs_review"), "reason": F.col("s.reason")}).drop("s")


def masked_only(df: DataFrame, spans: str = "spans") -> DataFrame:
    """df with those of its spans that are masked."""
    return df.withColumn(spans, F.filter(spans, lambda s: s["status"] == "mask"))


def findings(*channels: DataFrame) -> DataFrame:
    """Findings of all channels in one table; columns that one lacks are null."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), channels)


def still_there(ids: DataFrame, removed: DataFrame, column: str = "region_id") -> DataFrame:
    """Ids that were removed and are there again; there must be none."""
    return ids.select(column).intersect(removed.select(column))


def area_shares(regions: DataFrame, keys: list[str], width: int, height: int) -> DataFrame:
    """The least and greatest share of the frame, in percent, that one region of an event covers."""
    share = 100 * F.col("w") * F.col("h") / F.lit(width * height)
    return regions.groupBy(*keys).agg(F.bround(F.min(share), 4).alias("least_percent"), F.bround(F.max(share), 4).alias("most_percent"))


def acceptance(frames: DataFrame, key: str) -> DataFrame:
    """Whether a synthetic run is good. frames: key, frame, coverage (array, one for each link), normal_changed, changed_pixels."""
    links = F.size("coverage") > 0
    per = frames.groupBy(key).agg(
        F.count("*").alias("frames"), F.sum(F.aggregate("coverage", F.lit(0.0), lambda a, x: a + x)).alias("total"), F.sum(F.size("coverage")).alias("links"), F.min(F.array_min("coverage")).alias("least_coverage"),
        F.count_if(links & (F.array_min("coverage") < LEAST_COVERAGE)).alias("missed"), F.count_if(F.col("normal_changed") > MOST_NORMAL).alias("normal_changed"),
        F.count_if(~links & (F.col("changed_pixels") > MOST_STALE)).alias("stale"),
    )
    mean = F.when(F.col("links") > 0, F.col("total") / F.col("links"))
    return per.withColumns({"mean_coverage": mean, "passed": (F.col("missed") == 0) & (F.col("normal_changed") == 0) & (F.col("stale") == 0)}).drop("total", "links")


def page(df: DataFrame, order: list[str], number: int, size: int = 60, search: str = "", column: str = "text") -> DataFrame:
    """One page (from 0) of the rows that hold a text, whatever its case."""
    found = df.where(F.contains(F.lower(F.col(column)), F.lit(search.lower()))) if search else df
    return found.orderBy(*order).offset(number * size).limit(size)


def previews(frames: DataFrame, key: str, most: int = 12) -> DataFrame:
    """Frames to show of a source: each tenth part of it, so many at most."""
    n = frames.groupBy(key).agg(F.greatest(F.lit(1), F.bround(F.count("*") / 10, 0)).cast("bigint").alias("step"))
    return frames.join(n, key).where((F.col("frame") % F.col("step") == 0) & (F.col("frame") < most * F.col("step"))).select(key, "frame")
