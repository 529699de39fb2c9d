"""From a span and glyph boxes to a pixel rectangle and how far it can be trusted.

Built-in higher-order functions over the glyph array: no shuffle, no Python. An observation has text, box (x, y, w, h
as fractions of the frame, from the top left) and chars: array<struct<start,end,box>>.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

EPS = 1e-6
SLACK = 0.01
OVERLAP = 0.25


def _close(a: Column, b: Column) -> Column:
    out = F.lit(True)
    for k in "xywh":
        out = out & (F.abs(a[k] - b[k]) <= EPS)
    return out


def _finite(b: Column) -> Column:
    out = F.lit(True)
    for k in "xywh":
        out = out & b[k].isNotNull() & ~F.isnan(b[k]) & (F.abs(b[k]) < float("inf"))
    return out


def _common(a: Column, b: Column) -> Column:
    w = F.least(a["x"] + a["w"], b["x"] + b["w"]) - F.greatest(a["x"], b["x"])
    h = F.least(a["y"] + a["h"], b["y"] + b["h"]) - F.greatest(a["y"], b["y"])
    return F.greatest(F.lit(0.0), w) * F.greatest(F.lit(0.0), h)


def place_spans(df: DataFrame, width: int, height: int, padding: int = 4) -> DataFrame:
    """df (text, box, chars, start, end) with pixel_box and box_method."""
    start, end, text, outer = F.col("start"), F.col("end"), F.col("text"), F.col("box")
    n = F.length(text)
    ok = F.forall("chars", lambda c: c["start"].isNotNull() & c["end"].isNotNull() & (c["start"] >= 0) & (c["start"] < c["end"]) & (c["end"] <= n))
    inked = F.filter(F.sequence(F.lit(0), F.greatest(n - 1, F.lit(0))), lambda i: (i < n) & ~F.substr(text, i + 1, F.lit(1)).rlike(r"(?U)^\s$"))
    df = df.withColumn("__ink", inked).withColumn("__ok", F.coalesce(ok, F.lit(False)))
    wanted = F.filter("__ink", lambda i: (i >= start) & (i < end))
    inside = F.filter("chars", lambda c: F.col("__ok") & (c["start"] < end) & (c["end"] > start) & F.exists(wanted, lambda i: (i >= c["start"]) & (i < c["end"])))
    df = df.withColumn("__in", inside).withColumn("__out", F.filter("chars", lambda c: (c["end"] <= start) | (c["start"] >= end)))
    complete = F.forall(wanted, lambda i: F.exists("__in", lambda c: (c["start"] <= i) & (i < c["end"])))
    valid = F.forall("__in", lambda c: _finite(c["box"]) & (c["box"]["w"] > 0) & (c["box"]["h"] > 0) & (c["box"]["x"] >= outer["x"] - SLACK) & (c["box"]["y"] >= outer["y"] - SLACK)
                     & (c["box"]["x"] + c["box"]["w"] <= outer["x"] + outer["w"] + SLACK) & (c["box"]["y"] + c["box"]["h"] <= outer["y"] + outer["h"] + SLACK))
    crossing = F.exists("__in", lambda c: (c["start"] < start) | (c["end"] > end))
    shared = F.exists("__in", lambda c: F.exists("__out", lambda o: _close(c["box"], o["box"])))
    laps = F.exists("__in", lambda c: F.exists("__out", lambda o: _finite(o["box"]) & (_common(c["box"], o["box"]) / F.greatest(F.lit(1e-12), F.least(c["box"]["w"] * c["box"]["h"], o["box"]["w"] * o["box"]["h"])) > OVERLAP)))
    repeated = (F.size("__in") > 1) & F.forall("__in", lambda c: _close(c["box"], F.col("__in")[0]["box"]))
    method = F.when(crossing, "crossing_character_range").when(shared, "shared_character_boxes").when(laps, "overlapping_character_boxes").when(repeated, "repeated_character_boxes").otherwise("characters")
    precise = (F.size("__in") > 0) & complete & valid
    df = df.withColumn("box_method", F.when(F.coalesce(precise, F.lit(False)), method).otherwise("line_fallback"))
    by = lambda f: F.transform("__in", lambda c: f(c["box"]))
    exact = F.col("box_method") != "line_fallback"
    x, y = F.when(exact, F.array_min(by(lambda b: b["x"]))).otherwise(outer["x"]), F.when(exact, F.array_min(by(lambda b: b["y"]))).otherwise(outer["y"])
    right = F.when(exact, F.array_max(by(lambda b: b["x"] + b["w"]))).otherwise(outer["x"] + outer["w"])
    bottom = F.when(exact, F.array_max(by(lambda b: b["y"] + b["h"]))).otherwise(outer["y"] + outer["h"])
    df = df.withColumns({"__x": x, "__y": y}).withColumns({"__w": right - F.col("__x"), "__h": bottom - F.col("__y")})
    x, y, w, h = (F.col(f"__{k}") for k in "xywh")
    x1, y1 = F.greatest(F.lit(0), F.floor(x * width - padding)), F.greatest(F.lit(0), F.floor(y * height - padding))
    x2, y2 = F.least(F.lit(width), F.ceil(x * width + w * width + padding)), F.least(F.lit(height), F.ceil(y * height + h * height + padding))
    # Padding stops at a neighbour on the same row whose place is known.
    row = lambda b: (b["y"] < y + h) & (b["y"] + b["h"] > y)
    after = F.array_min(F.transform(F.filter("__out", lambda o: (o["start"] >= end) & (o["box"]["x"] >= x + w - EPS) & row(o["box"])), lambda o: o["box"]["x"] * width))
    before = F.array_max(F.transform(F.filter("__out", lambda o: (o["end"] <= start) & (o["box"]["x"] + o["box"]["w"] <= x + EPS) & row(o["box"])), lambda o: (o["box"]["x"] + o["box"]["w"]) * width))
    glyphs = F.col("box_method") == "characters"
    x2 = F.when(glyphs, F.least(x2, F.coalesce(F.floor(after), x2))).otherwise(x2)
    x1 = F.when(glyphs, F.greatest(x1, F.coalesce(F.ceil(before), x1))).otherwise(x1)
    pixel = F.struct(x1.cast("bigint").alias("x"), y1.cast("bigint").alias("y"), F.greatest(F.lit(0), x2 - x1).cast("bigint").alias("w"), F.greatest(F.lit(0), y2 - y1).cast("bigint").alias("h"))
    return df.withColumn("pixel_box", pixel).drop("__ink", "__ok", "__in", "__out", "__x", "__y", "__w", "__h")


def needs_independent_geometry(chars: Column) -> Column:
    """Whether some glyphs share one box, so that a second, fast pass is worth its cost."""
    return F.size(chars) > F.size(F.array_distinct(F.transform(chars, lambda c: c["box"])))
