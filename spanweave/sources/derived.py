"""Frames, regions and texts derived from the driver's tables by whole-number arithmetic.

The tables hold no recordings, so these views stand in for them: each user is a source, each event a frame of it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """source_id, frame (dense, from 0), event_id, event_type, value."""
    events = table(spark, sf_dir, "events").select(F.col("user_id").alias("source_id"), "event_id", "event_type", "value")
    return events.withColumn("frame", (F.row_number().over(Window.partitionBy("source_id").orderBy("event_id")) - 1).cast("bigint"))


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """source_id, event_id, role, category, start and end frames of reviewed events; not sorted, overlapping."""
    rows = table(spark, sf_dir, "events").select(F.col("user_id").alias("source_id"), "event_id", "event_type")
    start = F.col("event_id") * 53 % 2000
    role = F.when(F.col("event_id") % 7 == 0, "full_scene").when(F.col("event_id") % 11 == 0, "overlay").otherwise("local_redaction")
    return rows.select("source_id", "event_id", F.col("event_type").alias("category"), role.alias("role"), start.alias("start"), (start + 1 + F.col("event_id") % 9).alias("end"))


def cuts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """source_id, a, b: what was cut out of each source, in source frames."""
    rows = table(spark, sf_dir, "events").select(F.col("user_id").alias("source_id")).distinct()
    rows = rows.withColumn("k", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(4).cast("bigint"))))
    a = 100 + F.col("k") * 400 + F.col("source_id") % 37
    return rows.select("source_id", a.alias("a"), (a + 5 + F.col("source_id") % 6).alias("b"))


def regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """source_id, frame, ord, region_id, x, y, w, h, origin, box_method, scale, confidence: one or two for each event."""
    f = frames(spark, sf_dir).withColumn("ord", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("event_id") % 2)))
    e, o = F.col("event_id"), F.col("ord")
    return f.select(
        "source_id", "frame", "ord", F.concat(F.lit("U"), (F.col("frame") % 5).cast("string")).alias("region_id"),
        (100 + F.col("source_id") % 50 + e * 37 % 12 + o * 3).alias("x"), (200 + e * 91 % 10 + o * 2).alias("y"), (60 + e * 13 % 30).alias("w"), (20 + e * 7 % 8).alias("h"),
        F.when(e % 3 == 0, "ocr").when(e % 3 == 1, "tracked").otherwise("backfilled").alias("origin"),
        F.when(e % 10 == 0, "line_fallback").otherwise("characters").alias("box_method"), F.when(e % 4 == 0, "0.94").when(e % 4 == 1, "1.06").otherwise("1.0").alias("scale"),
        (F.col("value") / 500).alias("confidence"),
    )
