"""Sinks: nothing that exists is overwritten, and a report is written whether or not the work succeeded."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import clock

#: Columns of a published timeline, in order.
TIMELINE = ["ordinal", "start_seconds", "end_seconds", "source_start_seconds", "source_end_seconds", "start_frame", "end_frame", "source_start_frame", "source_end_frame"]


def write_table(df: DataFrame, path: str, fmt: str = "parquet") -> None:
    """Write a table to a new place."""
    df.write.mode("errorifexists").format(fmt).option("header", "true").save(path)


@contextmanager
def report(spark: SparkSession, path: str, facts: dict[str, str]) -> Iterator[dict[str, str]]:
    """A report row below path: status complete, or failed with the kind of the error; written in either case."""
    facts = {"status": "processing", **facts}
    try:
        yield facts
        facts["status"] = "complete"
    except BaseException as error:
        facts |= {"status": "failed", "error": type(error).__name__}
        raise
    finally:
        row = spark.createDataFrame([(facts,)], "facts map<string,string>")
        row.select(F.to_json("facts").alias("value")).coalesce(1).write.mode("errorifexists").text(f"{path}/report")


def timeline(intervals: DataFrame, fps_num: int, fps_den: int = 1, keys: tuple[str, ...] = ()) -> DataFrame:
    """Intervals (ordinal, start, end, source_start, source_end) with seconds, as published; keys tell timelines apart."""
    rate = fps_num / fps_den
    named = {"start": "start_frame", "end": "end_frame", "source_start": "source_start_frame", "source_end": "source_end_frame"}
    rows = intervals.withColumnsRenamed(named)
    rows = rows.withColumns({c.replace("_frame", "_seconds"): F.col(c) / F.lit(rate) for c in named.values()})
    return rows.select(*keys, *TIMELINE)


def timeline_lines(rows: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """Lines of a Markdown table of a timeline, numbered; keys tell timelines apart."""
    shown = [clock.minutes(clock.milliseconds(F.col(f"{p}{e}_seconds"))) for p in ("", "source_") for e in ("start", "end")]
    return rows.select(*keys, "ordinal", F.format_string("| %d | %s–%s | %s–%s |", "ordinal", *shown).alias("line"))


def write_timeline(intervals: DataFrame, path: str, fps_num: int, fps_den: int = 1) -> None:
    """JSON, CSV and Markdown lines below a new folder."""
    rows = timeline(intervals, fps_num, fps_den)
    write_table(rows, f"{path}/json", "json")
    write_table(rows.orderBy("ordinal"), f"{path}/csv", "csv")
    write_table(timeline_lines(rows).orderBy("ordinal").select(F.col("line").alias("value")), f"{path}/markdown", "text")


def catalog_faults(catalog: DataFrame, tree: DataFrame) -> DataFrame:
    """Files (path, bytes, sha256) that only one of an archive's catalog and its tree has."""
    from ..operators.patches import unequal

    columns = ["path", "bytes", "sha256"]
    return unequal(catalog.select(*columns), tree.select(*columns))


def catalog_totals(catalog: DataFrame) -> DataFrame:
    return catalog.agg(F.count("*").alias("file_count"), F.coalesce(F.sum("bytes"), F.lit(0)).cast("bigint").alias("logical_bytes"))
