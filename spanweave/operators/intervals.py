"""Interval algebra over half-open frame ranges, partitioned by source.

All operators are windows or bounded arrays per source; nothing is collected. Where a source's cuts are needed they
travel as one sorted array for each source, so the join is by source alone and never by range.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


#: Frames of a source that one window holds when runs are made.
STRETCH = 1 << 16


def runs(df: DataFrame, flag: Column, keys: list[str], frame: str = "frame") -> DataFrame:
    """Half-open runs of consecutive frames for which flag holds.

    Frames become runs within stretches of a source first, so a source with most of the rows is dealt over many tasks;
    only the runs meet by source, where those that touch are joined.
    """
    part = [*keys, "__stretch"]
    marked = df.where(flag).withColumn("__stretch", F.floor(F.col(frame) / STRETCH))
    marked = marked.withColumn("__island", F.col(frame) - F.row_number().over(Window.partitionBy(*part).orderBy(frame)))
    pieces = marked.groupBy(*part, "__island").agg(F.min(frame).alias("start"), (F.max(frame) + 1).alias("end")).drop("__island", "__stretch")
    return merge_gaps(pieces, keys, 0)


def _merged(df: DataFrame, keys: list[str], starts_new: Column, extra: list[Column]) -> DataFrame:
    w = Window.partitionBy(*keys).orderBy("start", "end").rowsBetween(Window.unboundedPreceding, 0)
    numbered = df.withColumn("__group", F.sum(F.when(starts_new, 1).otherwise(0)).over(w))
    return numbered.groupBy(*keys, "__group").agg(F.min("start").alias("start"), F.max("end").alias("end"), *extra).drop("__group")


def merge_gaps(df: DataFrame, keys: list[str], max_gap: int, extra: list[Column] | None = None) -> DataFrame:
    """Join intervals whose gap is at most max_gap frames; 0 joins those that touch or overlap."""
    if max_gap < 0:
        raise ValueError("max_gap must not be negative")
    w = Window.partitionBy(*keys).orderBy("start", "end").rowsBetween(Window.unboundedPreceding, -1)
    known = df.withColumn("__before", F.max("end").over(w))
    return _merged(known, keys, F.col("__before").isNull() | (F.col("start") - F.col("__before") > max_gap), extra or [])


def bad_intervals(df: DataFrame, keys: list[str], event: str = "event_id") -> DataFrame:
    """Rows that a sorted list of disjoint, nonempty intervals must not have; of equal intervals the least event comes first."""
    w = Window.partitionBy(*keys).orderBy("start", "end", event).rowsBetween(Window.unboundedPreceding, -1)
    return df.withColumn("__before", F.max("end").over(w)).where((F.col("start") >= F.col("end")) | (F.col("start") < F.col("__before"))).drop("__before")


def cut_boundaries(cuts: DataFrame, key: str) -> DataFrame:
    """key, cuts: the source cuts (a, b) of each source as an array of boundary (in output frames) and length."""
    w = Window.partitionBy(key).orderBy("a").rowsBetween(Window.unboundedPreceding, -1)
    placed = cuts.withColumn("boundary", F.col("a") - F.coalesce(F.sum(F.col("b") - F.col("a")).over(w), F.lit(0)))
    entry = F.struct(F.col("boundary").cast("bigint").alias("boundary"), (F.col("b") - F.col("a")).cast("bigint").alias("length"))
    return placed.groupBy(key).agg(F.array_sort(F.collect_list(entry)).alias("cuts"))


def with_cuts(df: DataFrame, cuts: DataFrame, key: str) -> DataFrame:
    """df with each source's cut array; empty where it has none."""
    joined = df.join(cut_boundaries(cuts, key), key, "left")
    return joined.withColumn("cuts", F.coalesce("cuts", F.array().cast("array<struct<boundary:bigint,length:bigint>>")))


def to_source(frame: Column, cuts: Column) -> Column:
    """The source frame of an output frame: what was cut out before it comes on top."""
    return F.aggregate(F.filter(cuts, lambda c: c["boundary"] <= frame), frame.cast("bigint"), lambda a, c: a + c["length"])


def to_output(frame: Column, cuts: Column) -> Column:
    """The output frame of a source frame; null if it was cut out."""
    state = F.struct(frame.cast("bigint").alias("f"), F.lit(False).alias("gone"), F.lit(0).cast("bigint").alias("removed"))

    def step(s: Column, c: Column) -> Column:
        start = c["boundary"] + s["removed"]  # the cut's first source frame
        return F.struct(s["f"].alias("f"), (s["gone"] | ((s["f"] >= start) & (s["f"] < start + c["length"]))).alias("gone"), (s["removed"] + F.when(s["f"] >= start, c["length"]).otherwise(0)).alias("removed"))

    return F.aggregate(cuts, state, step, lambda s: F.when(~s["gone"], s["f"] - s["removed"]))


def merge_at_cuts(events: DataFrame, cuts: DataFrame, key: str, event: str = "event_id") -> DataFrame:
    """Merge overlapping and touching events into intervals that no cut runs through.

    Events are split at cuts inside them, and pieces between the same two cuts merge. Each interval has its number,
    the events in it and its source frames.
    """
    rows = with_cuts(events, cuts, key)
    inner = F.transform(F.filter("cuts", lambda c: (c["boundary"] > F.col("start")) & (c["boundary"] < F.col("end"))), lambda c: c["boundary"])
    edges = F.array_sort(F.array_distinct(F.concat(F.array(F.col("start").cast("bigint"), F.col("end").cast("bigint")), inner)))
    rows = rows.withColumn("__e", edges).withColumn("__p", F.explode(F.sequence(F.lit(1), F.size("__e") - 1)))
    rows = rows.withColumn("start", F.element_at("__e", F.col("__p"))).withColumn("end", F.element_at("__e", F.col("__p") + 1))
    rows = rows.withColumn("__cut", F.size(F.filter("cuts", lambda c: c["boundary"] <= F.col("start"))))
    merged = merge_gaps(rows, [key, "__cut"], 0, [F.sort_array(F.collect_set(event)).alias("events"), F.first("cuts").alias("cuts")])
    ordinal = F.row_number().over(Window.partitionBy(key).orderBy("start"))
    return merged.select(
        key, ordinal.alias("ordinal"), "start", "end", "events",
        to_source(F.col("start"), F.col("cuts")).alias("source_start"), (to_source(F.col("end") - 1, F.col("cuts")) + 1).alias("source_end"),
    )


def activity_windows(df: DataFrame, keys: list[str], max_gap: int) -> DataFrame:
    """Activity joined over gaps, with its active frames and number of intervals."""
    return merge_gaps(df, keys, max_gap, [F.sum(F.col("end") - F.col("start")).alias("active_frames"), F.count("*").alias("intervals")])


def catalog(segments: DataFrame, masked: DataFrame, key: str) -> DataFrame:
    """Segments numbered, with their place in the collection and their masked and context frames.

    masked: the runs of masked frames that the segments were merged from, so each run lies in one segment.
    """
    w = Window.partitionBy(key).orderBy("start")
    placed = segments.withColumn("segment", F.row_number().over(w)).withColumn("frames", F.col("end") - F.col("start"))
    offset = F.coalesce(F.sum("frames").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    placed = placed.withColumn("collection_start", offset.cast("bigint"))
    # A run belongs to the last segment that starts at or before it: found by one sort, without a range join.
    both = placed.select(key, F.col("start").alias("at"), F.col("segment"), F.lit(0).cast("bigint").alias("n"), F.lit(0).alias("side")).unionByName(
        masked.select(key, F.col("start").alias("at"), F.lit(None).cast("int").alias("segment"), (F.col("end") - F.col("start")).alias("n"), F.lit(1).alias("side"))
    )
    owner = F.last("segment", ignorenulls=True).over(Window.partitionBy(key).orderBy("at", "side").rowsBetween(Window.unboundedPreceding, 0))
    counts = both.withColumn("owner", owner).groupBy(key, F.col("owner").alias("segment")).agg(F.sum("n").cast("bigint").alias("masked_frames"))
    out = placed.join(counts, [key, "segment"])
    return out.select(
        key, "segment", "start", "end", "frames", "collection_start", (F.col("collection_start") + F.col("frames")).alias("collection_end"),
        "masked_frames", (F.col("frames") - F.col("masked_frames")).alias("context_frames"),
    )


def frame_mapping(entries: DataFrame, key: str) -> DataFrame:
    """One row for each frame of the collection: its segment and place there, and its source frame."""
    out = entries.withColumn("segment_frame", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("frames") - 1)))
    return out.select(key, "segment", "segment_frame", (F.col("collection_start") + F.col("segment_frame")).alias("collection_frame"), (F.col("start") + F.col("segment_frame")).alias("source_frame"))


def keyframe_windows(frames: DataFrame, keyframes: DataFrame, sources: DataFrame, key: str) -> DataFrame:
    """What to encode anew: for each changed frame the range between the keyframes around it, touching ranges joined.

    sources: key, n_frames; after its last keyframe a source's range goes to its end.
    """
    both = keyframes.select(key, "frame", F.lit(0).alias("side")).unionByName(frames.select(key, "frame", F.lit(1).alias("side")))
    w = Window.partitionBy(key).orderBy("frame", "side")
    k = F.when(F.col("side") == 0, F.col("frame"))
    start = F.max(k).over(w.rowsBetween(Window.unboundedPreceding, 0))
    after = F.min(k).over(w.rowsBetween(1, Window.unboundedFollowing))
    placed = both.withColumns({"start": F.coalesce(start, F.lit(0)), "after": after}).where("side = 1").join(sources.select(key, "n_frames"), key)
    placed = placed.withColumn("end", F.coalesce("after", "n_frames"))
    return merge_gaps(placed.select(key, F.col("start").cast("bigint"), F.col("end").cast("bigint")).distinct(), [key], 0)


def segments(frames: DataFrame, key: str, is_cut: Column) -> DataFrame:
    """Ranges of consecutive frames between cuts."""
    w = Window.partitionBy(key).orderBy("frame")
    new = F.lag("frame").over(w).isNull() | (F.col("frame") != F.lag("frame").over(w) + 1) | is_cut
    numbered = frames.withColumn("__new", F.when(new, 1).otherwise(0)).withColumn("segment", F.sum("__new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return numbered.groupBy(key, "segment").agg(F.min("frame").alias("start"), (F.max("frame") + 1).alias("end"), F.count("*").alias("n_frames"))


def index_faults(frames: DataFrame, key: str) -> DataFrame:
    """Frames that break the dense numbering from zero, and what was expected there."""
    w = Window.partitionBy(key).orderBy("frame")
    return frames.withColumn("expected", F.coalesce(F.lag("frame").over(w) + 1, F.lit(0))).where("frame <> expected").select(key, "frame", "expected")


def checkpoints(intervals: DataFrame, step: int) -> DataFrame:
    """Frames to look at in each interval: first, middle, last, and one at each step."""
    first, last = F.col("start"), F.col("end") - 1
    grid = F.sequence(first, last, F.lit(step).cast("bigint"))
    return intervals.withColumn("checkpoints", F.array_sort(F.array_distinct(F.concat(grid, F.array(F.floor((first + last) / 2).cast("bigint"), last)))))


def short_gaps(df: DataFrame, keys: list[str], longest: int) -> DataFrame:
    """Gaps of more than one frame up to the longest between frames of one key."""
    after = F.lead("frame").over(Window.partitionBy(*keys).orderBy("frame"))
    gaps = df.withColumn("next_frame", after).withColumn("gap", F.col("next_frame") - F.col("frame"))
    return gaps.where((F.col("gap") > 1) & (F.col("gap") <= longest)).select(*keys, "frame", "next_frame", "gap")


def clip(df: DataFrame, start: int, end: int) -> DataFrame:
    """Intervals that overlap [start, end), cut to it."""
    kept = df.where((F.col("end") > start) & (F.col("start") < end))
    return kept.withColumn("start", F.greatest("start", F.lit(start))).withColumn("end", F.least("end", F.lit(end)))
