"""SRT subtitles: blocks between blank lines, each with an optional number, a time line and text."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.clock import srt_milliseconds

_TIME = r"^(\d+:\d{2}:\d{2}[,.]\d{3})\s*-->\s*(\d+:\d{2}:\d{2}[,.]\d{3})$"


def read_srt(spark: SparkSession, path: str) -> DataFrame:
    """One row for each file: source_id (its path) and content, without a byte order mark."""
    files = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("source_id"), "value")
    return files.select("source_id", F.regexp_replace("value", "^﻿", "").alias("content"))


def segments(files: DataFrame) -> DataFrame:
    """source_id, seq, start_ms, end_ms, text, valid. A block that does not fit is a row with valid = false.

    Built-in functions alone. Empty files have no rows; a file with any invalid row must count as failed.
    """
    plain = F.regexp_replace("content", "\r\n", "\n")
    blocks = files.select("source_id", F.posexplode(F.split(plain, r"\n\s*\n")).alias("seq", "block"))
    blocks = blocks.withColumn("block", F.regexp_replace("block", r"^\s+|\s+$", "")).where("block <> ''")
    lines = blocks.withColumn("l", F.split("block", "\n"))
    at = F.when(F.trim(F.col("l")[0]).rlike(r"^\d+$"), 1).otherwise(0)
    lines = lines.withColumn("at", at).withColumn("time", F.trim(F.get("l", F.col("at"))))
    start, end = (srt_milliseconds(F.regexp_extract("time", _TIME, i)) for i in (1, 2))
    out = lines.withColumns({"start_ms": start, "end_ms": end, "n": F.size("l")})
    text = F.array_join(F.slice("l", F.col("at") + 2, F.greatest(F.col("n") - F.col("at") - 1, F.lit(0))), "\n")
    good = (F.col("n") > F.col("at") + 1) & F.col("start_ms").isNotNull() & F.col("end_ms").isNotNull() & (F.col("end_ms") >= F.col("start_ms"))
    return out.select("source_id", F.col("seq").cast("bigint"), "start_ms", "end_ms", text.alias("text"), F.coalesce(good, F.lit(False)).alias("valid"))


def in_window(rows: DataFrame, start_ms: int, end_ms: int, offset_ms: int = 0) -> DataFrame:
    """Segments that overlap the window, cut to it."""
    a, b = F.col("start_ms") + offset_ms, F.col("end_ms") + offset_ms
    kept = rows.where((b > start_ms) & (a < end_ms))
    return kept.withColumns({"start_ms": F.greatest(a, F.lit(start_ms)), "end_ms": F.least(b, F.lit(end_ms))})
