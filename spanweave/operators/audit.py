"""Audit: summaries of events, origins and statuses, and the ledger of what was inspected."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..runtime import scratch_dir

STATUSES = ("mask", "needs_review", "keep")


def status_summary(rows: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Counts of each status, those without rows too, and what must follow."""
    counts = [F.count_if(F.col("status") == s).cast("bigint").alias(s) for s in STATUSES]
    out = rows.groupBy(*(by or [])).agg(*counts)
    return out.withColumn("acceptance", F.when(F.col("needs_review") > 0, "needs_review").otherwise("not_verified"))


def pending(rows: DataFrame, order: list[str]) -> DataFrame:
    """Rows that are not kept, numbered R000001 on in one order of all.

    Rows are sorted in ranges and staged with their place within them; a range's offset is the sum of those before it,
    so no task holds more than a range.
    """
    spark = rows.sparkSession
    path = f"{scratch_dir(spark)}/pending"
    # The identity counts up within a partition; its number is in the bits above.
    rows.where("status <> 'keep'").repartitionByRange(*order).sortWithinPartitions(*order).withColumn("__at", F.monotonically_increasing_id()).write.parquet(path)
    placed = spark.read.parquet(path).withColumns({"__range": F.shiftright("__at", 33), "__at": F.col("__at").bitwiseAND((1 << 33) - 1)})
    sizes = placed.groupBy("__range").agg(F.count("*").alias("__n"))
    before = F.coalesce(F.sum("__n").over(Window.orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = sizes.select("__range", before.alias("__before"))
    numbered = placed.join(F.broadcast(offsets), "__range")  # a row for each range
    return numbered.withColumn("finding_id", F.format_string("R%06d", F.col("__before") + F.col("__at") + 1)).drop("__range", "__at", "__before")


def event_rollup(regions: DataFrame, keys: list[str]) -> DataFrame:
    """Extent, movement, confidence and reasons for a look of each event (keys: source and event)."""
    w = Window.partitionBy(*keys).orderBy("frame", "ord")
    cx, cy = F.col("x") + F.col("w") / 2, F.col("y") + F.col("h") / 2
    rows = regions.withColumns({"cx": cx, "cy": cy}).withColumns({"px": F.lag("cx").over(w), "py": F.lag("cy").over(w)})
    rows = rows.withColumn("step", F.coalesce(F.hypot(F.col("cx") - F.col("px"), F.col("cy") - F.col("py")), F.lit(0.0)))
    ends = [f(c).alias(f"{n}_{c}") for c in "xywh" for n, f in (("min", F.min), ("max", F.max))]
    out = rows.groupBy(*keys).agg(
        F.min("frame").alias("first_frame"), F.max("frame").alias("last_frame"), F.count("*").alias("n_regions"), *ends,
        F.hypot(F.max("cx") - F.min("cx"), F.max("cy") - F.min("cy")).alias("span"), F.max("step").alias("max_step"),
        F.min("confidence").alias("min_confidence"), F.max("confidence").alias("max_confidence"), F.count_if(F.col("box_method") == "line_fallback").alias("fallbacks"),
    )
    out = out.withColumns({"width_ratio": F.col("max_w") / F.greatest(F.lit(1), "min_w"), "height_ratio": F.col("max_h") / F.greatest(F.lit(1), "min_h")})
    ratio = F.greatest("width_ratio", "height_ratio")
    reasons = F.array_compact(F.array(F.when(ratio > 1.25, "size"), F.when(F.col("max_step") > 50, "step"), F.when(F.col("fallbacks") > 0, "line_fallback")))
    return out.withColumns({"moves": F.col("span") > 10, "scales": ratio > 1.1, "reasons": F.concat_ws(",", reasons)})


def grouping_counts(regions: DataFrame) -> DataFrame:
    """Regions by origin, by method, by scale within origin, and in all, in one pass."""
    view = regions.select("origin", "box_method", "scale")
    counted = view.groupingSets([["origin"], ["box_method"], ["origin", "scale"], []], "origin", "box_method", "scale").agg(F.count("*").alias("n"), F.grouping_id().cast("bigint").alias("set_id"))
    total = view.agg(F.count("*").alias("total"))
    return counted.crossJoin(F.broadcast(total)).select("origin", "box_method", "scale", "set_id", "n", F.bround(100 * F.col("n") / F.col("total"), 4).alias("percent"))


def coverage(frames: DataFrame, expected: DataFrame) -> DataFrame:
    """One row for each source: frames decoded, checked, failed and skipped, the code of the first failure, the result.

    frames: source_id, frame, state (checked, failed, skipped, worker_failed, truncated); expected: source_id,
    expected_frames, decoder_exit. Codes in the order of precedence: a truncated frame, the worker, the decoder's exit,
    missing frames, failed frames.
    """
    count = lambda c: F.count_if(c).cast("bigint")
    per = frames.groupBy("source_id").agg(
        count(F.col("state") != "truncated").alias("decoded_frames"), count(F.col("state") == "checked").alias("checked_frames"),
        count(F.col("state").isin("failed", "worker_failed")).alias("failed_frames"), count(F.col("state") == "skipped").alias("skipped_frames"),
        F.max((F.col("state") == "truncated").cast("int")).alias("truncated"), F.max((F.col("state") == "worker_failed").cast("int")).alias("worker"),
        F.min(F.when(F.col("state").isin("failed", "worker_failed"), F.col("frame"))).alias("first_failed_frame"), count(F.col("hit")).alias("hits"),
    )
    zero = {c: 0 for c in ("decoded_frames", "checked_frames", "failed_frames", "skipped_frames", "truncated", "worker", "hits")}
    rows = expected.join(per, "source_id", "left").fillna(zero)
    code = (
        F.when(F.col("truncated") > 0, "truncated_frame").when(F.col("worker") > 0, "ocr_worker_failed").when(F.col("decoder_exit") != 0, "decoder_failed")
        .when((F.col("decoded_frames") == 0) | (F.col("decoded_frames") != F.col("expected_frames")), "decoded_coverage_incomplete").when(F.col("failed_frames") > 0, "ocr_coverage_incomplete")
    )
    rows = rows.withColumn("failure_code", code)
    result = F.when(F.col("failure_code").isNotNull(), "failed").when(F.col("hits") > 0, "hits").otherwise("no_hits")
    return rows.withColumn("result", result).select("source_id", "expected_frames", "decoded_frames", "checked_frames", "failed_frames", "skipped_frames", "first_failed_frame", "failure_code", "result")


def channel_rollup(rows: DataFrame, key: str) -> DataFrame:
    """State of a channel from those of its tracks: failed before checked before not_checked before not_applicable."""
    rank = F.when(F.col("state") == "failed", 3).when(F.col("state") == "checked", 2).when(F.col("state") == "not_checked", 1).otherwise(0)
    out = rows.groupBy(key, "channel").agg(F.max(rank).alias("r"), F.count("*").alias("tracks"))
    names = F.array(*[F.lit(s) for s in ("not_applicable", "not_checked", "checked", "failed")])
    return out.select(key, "channel", F.element_at(names, F.col("r") + 1).alias("state"), "tracks")


def role_counts(events: DataFrame, key: str, roles: list[str]) -> DataFrame:
    """Events of each role, those without events too."""
    return events.groupBy(key).agg(*[F.count_if(F.col("role") == r).cast("bigint").alias(r) for r in roles])


def all_pass(checks: DataFrame, key: str, passed: str = "passed") -> DataFrame:
    return checks.groupBy(key).agg(F.every(passed).alias("all_passed"), F.count("*").alias("checks"))


def digital_silence(samples: DataFrame, key: str) -> DataFrame:
    """Peak and count of PCM samples by key; only a peak of exactly 0 is silence."""
    out = samples.groupBy(key).agg(F.max(F.abs("sample")).alias("peak"), F.count("*").alias("samples"), F.count_if(F.isnan("sample") | F.col("sample").isNull()).alias("invalid"))
    return out.withColumn("silent", (F.col("peak") == 0) & (F.col("invalid") == 0))


def dominant_colour(pixels: DataFrame, key: str, least: int = 8, share: float = 0.25) -> DataFrame:
    """Median colour of the fullest of 16 x 16 x 16 bins, if it holds enough of a region's pixels; ties to the least bin."""
    bin_of: Column = F.floor(F.col("r") / 16) * 256 + F.floor(F.col("g") / 16) * 16 + F.floor(F.col("b") / 16)
    binned = pixels.withColumn("bin", bin_of.cast("bigint"))
    bins = binned.groupBy(key, "bin").agg(F.count("*").alias("n"), *[F.median(c).alias(c) for c in "rgb"])
    top = bins.groupBy(key).agg(F.sum("n").alias("total"), F.max(F.struct("n", (-F.col("bin")).alias("minus"), *"rgb")).alias("t"))
    fits = (F.col("t.n") >= least) & (F.col("t.n") >= share * F.col("total"))
    return top.where(fits).select(key, (-F.col("t.minus")).alias("bin"), F.col("t.n").alias("n"), *[F.col(f"t.{c}").alias(c) for c in "rgb"])


def byte_range(df: DataFrame, header: str = "header", size: str = "size") -> DataFrame:
    """A single range header's first and last byte, and the status it gets: 200 without one, 206, or 416."""
    part = [F.regexp_extract(F.coalesce(header, F.lit("")), r"^bytes=(\d*)-(\d*)$", i) for i in (1, 2)]
    a, b = [F.when(p != "", p).cast("bigint") for p in part]
    absent, n = F.col(header).isNull() | (F.col(header) == ""), F.col(size)
    first = F.when(absent, 0).when(a.isNotNull(), a).when(b.isNotNull(), F.greatest(F.lit(0), n - b))
    last = F.when(absent | a.isNull() | b.isNull(), n - 1).otherwise(F.least(b, n - 1))
    tail = a.isNull() & b.isNotNull() & (b > 0)
    good = (n > 0) & (tail | (a.isNotNull() & (first < n) & (last >= first)))
    status = F.when(absent, 200).when(F.coalesce(good, F.lit(False)), 206).otherwise(416)
    return df.withColumns({"first_byte": F.when(status != 416, first), "last_byte": F.when(status != 416, last), "status": status})
