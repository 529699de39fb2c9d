"""Queries of alignment, subtitles and published timelines."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import boxes
from ..operators import alignment, intervals
from ..sources import derived, sinks, subtitles
from . import audit
from .intervals import _with
from .oracle_views import FRAMES, REGIONS


def anchor_chains(spark, d):
    """The nearest anchor that each frame can be reached from, over steps that hold."""
    e = F.col("event_id")
    f = derived.frames(spark, d).select("source_id", "frame", (e % 8 == 0).alias("is_anchor"), (e % 5 != 0).alias("follows"), (e % 17 == 0).alias("cut"))
    return alignment.anchor_reach(f)


def nearest_anchor_proposals(spark, d):
    f = derived.frames(spark, d).select("source_id", "frame")
    p = f.withColumn("anchor", F.explode(F.array(F.col("frame") - F.col("frame") % 7, F.col("frame") + 3, F.col("frame") - 3)))
    return alignment.nearest_anchor(p)


def distinct_frame_boxes(spark, d):
    """Boxes of ten frames together, without those that one before covers by more than .8, in order of frame."""
    r = derived.regions(spark, d).withColumn("stretch", F.floor(F.col("frame") / 10).cast("bigint"))
    rows = r.groupBy("source_id", "stretch").agg(F.array_sort(F.collect_list(F.struct("frame", "ord", boxes.box("x", "y", "w", "h").alias("b")))).alias("s"))
    kept = alignment.distinct_boxes(F.transform("s", lambda x: x["b"]), 0.8)
    return rows.select("source_id", "stretch", F.size("s").alias("boxes"), F.size(kept).alias("kept"))


def linked_events(spark, d):
    """Regions of each source, and pairs of following frames in which events differ from the nearest-first choice (none)."""
    cuts = derived.frames(spark, d).where("event_id % 17 = 0").select("source_id", "frame")
    regions = derived.regions(spark, d)
    rows = alignment.link_events(regions, cuts).join(regions.select("source_id", "frame", "ord", *"xywh"), ["source_id", "frame", "ord"])
    first, number = (F.split("event_id", "-")[i].cast("bigint") for i in (0, 1))
    rows = rows.withColumns({"segment": first, "number": number, "parts": F.lit(1)})
    ends = ["ord", "number", "region_id", *"xywh"]
    i, k = F.col("i"), F.col("k")
    p = audit._meeting(audit._ends(rows, "i", ends).join(audit._ends(rows, "k", ends), ["source_id", "segment", "at"]))
    reach = F.greatest(F.lit(160), 3 * F.greatest(i["h"], k["h"]), F.greatest(i["w"], k["w"]) / 2)
    p = p.withColumns({"fits": (i["region_id"] == k["region_id"]) & (((F.col("wide") > 0) & (F.col("high") > 0)) | (F.col("far") <= reach)), "rank": F.struct(F.round("far", 9), i["ord"], k["number"])})
    # An event that goes on over a cut or a missing frame is a fault too.
    frames = derived.frames(spark, d).select("source_id", "frame", (F.col("event_id") % 17 == 0).alias("cut"))
    over = rows.join(frames, ["source_id", "frame"]).where("cut AND frame <> segment").select("source_id")
    faults = audit._unfair(p, i["number"] == k["number"], False).select("source_id")
    return audit._by_source(rows, faults.unionByName(over))


def code_findings(spark, d):
    e = F.col("event_id")
    rows = derived.frames(spark, d).select("source_id", "frame", F.struct((e % 128 / 128).alias("x"), (e % 64 / 64).alias("y"), (e % 16 / 128).alias("w"), (e % 8 / 64).alias("h")).alias("box"), F.when(e % 2 == 0, F.col("value") / 500).alias("confidence"))
    out = alignment.code_findings(rows, 256, 128)
    return out.select("source_id", "frame", "kind", "status", "reason", *[F.col(f"pixel_box.{c}").alias(c) for c in "xywh"], "confidence")


def _srt(spark, d):
    """One subtitle file for each conversation, a block for each turn."""
    stamp = lambda ms: F.format_string("%02d:%02d:%02d,%03d", F.floor(ms / 3600000), F.floor(ms / 60000) % 60, F.floor(ms / 1000) % 60, ms % 1000)
    ms = F.col("turn") * 61500
    block = F.concat_ws("\n", (F.col("turn") + 1).cast("string"), F.concat(stamp(ms), F.lit(" --> "), stamp(ms + 1250)), F.concat(F.lit("said by "), F.coalesce("role", F.lit("-"))))
    rows = derived.table(spark, d, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", block.alias("b")))).alias("blocks"))
    return rows.select(F.col("conv_id").cast("string").alias("source_id"), F.array_join(F.transform("blocks", lambda x: x["b"]), "\n\n").alias("content"))


def srt_segments(spark, d):
    return subtitles.segments(_srt(spark, d))


def srt_window(spark, d):
    return subtitles.in_window(subtitles.segments(_srt(spark, d)).where("valid"), 61000, 130000, 500)


def published_timeline(spark, d):
    """The timeline of each source's local events, a line for each interval."""
    rows = derived.events(spark, d).where("role = 'local_redaction'")
    out = intervals.merge_at_cuts(rows, derived.cuts(spark, d), "source_id")
    key = ("source_id",)
    return sinks.timeline_lines(sinks.timeline(out, 30, keys=key), key).withColumn("ordinal", F.col("ordinal").cast("bigint"))


QUERIES = {f.__name__: f for f in (anchor_chains, nearest_anchor_proposals, distinct_frame_boxes, linked_events, code_findings, srt_segments, srt_window, published_timeline)}

_CHAIN = f"""{FRAMES}, c AS (SELECT source_id, frame, event_id % 8 = 0 AS hit, sum(CASE WHEN event_id % 5 = 0 OR event_id % 17 = 0 OR frame = 0 THEN 1 ELSE 0 END) OVER (PARTITION BY source_id ORDER BY frame) AS chain FROM frames)"""
_SAID = """s AS (SELECT CAST(conv_id AS VARCHAR) AS source_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS seq, CAST(turn * 61500 AS BIGINT) AS start_ms, CAST(turn * 61500 + 1250 AS BIGINT) AS end_ms, 'said by ' || coalesce(role, '-') AS text, true AS valid FROM conversations)"""


_COMMON = "(greatest(0, least(o.x + o.w, s.b.x + s.b.w) - greatest(o.x, s.b.x)) * greatest(0, least(o.y + o.h, s.b.y + s.b.h) - greatest(o.y, s.b.y)))"
_KEPT = f"{_COMMON} / greatest(1, o.w * o.h + s.b.w * s.b.h - {_COMMON})"


def _stamp(frame: str) -> str:
    ms = f"CAST(round({frame} * 1000 / 30) AS BIGINT)"
    return f"printf('%02d:%02d.%03d', {ms} // 60000, {ms} // 1000 % 60, {ms} % 1000)"


ORACLES = {
    "anchor_chains": f"WITH {_CHAIN} SELECT a.source_id, a.frame, b.frame AS anchor FROM c a JOIN c b ON a.source_id = b.source_id AND a.chain = b.chain AND b.hit QUALIFY row_number() OVER (PARTITION BY a.source_id, a.frame ORDER BY abs(a.frame - b.frame), b.frame) = 1",
    "nearest_anchor_proposals": f"WITH {FRAMES}, p AS (SELECT source_id, frame, unnest([frame - frame % 7, frame + 3, frame - 3]) AS anchor FROM frames) SELECT * FROM p QUALIFY row_number() OVER (PARTITION BY source_id, frame ORDER BY abs(frame - anchor), anchor) = 1",
    "linked_events": f"WITH {REGIONS} SELECT source_id, count(*) AS regions, CAST(0 AS BIGINT) AS faults FROM regions GROUP BY 1",
    "distinct_frame_boxes": f"""WITH RECURSIVE {REGIONS}, s AS (SELECT source_id, frame // 10 AS stretch, row_number() OVER (PARTITION BY source_id, frame // 10 ORDER BY frame, ord) AS k, {{'x': x, 'y': y, 'w': w, 'h': h}} AS b FROM regions),
g AS (SELECT source_id, stretch, k, [b] AS kept FROM s WHERE k = 1
  UNION ALL SELECT g.source_id, g.stretch, s.k, CASE WHEN len(list_filter(g.kept, lambda o: {_KEPT} > 0.8)) > 0 THEN g.kept ELSE list_append(g.kept, s.b) END FROM g JOIN s ON s.source_id = g.source_id AND s.stretch = g.stretch AND s.k = g.k + 1)
SELECT source_id, stretch, CAST(max(k) AS INT) AS boxes, CAST(arg_max(len(kept), k) AS INT) AS kept FROM g GROUP BY 1, 2""",
    "code_findings": f"""WITH {FRAMES}, b AS (SELECT source_id, frame, greatest(0, floor(event_id % 128 / 128 * 256 - 4)) AS x1, greatest(0, floor(event_id % 64 / 64 * 128 - 4)) AS y1, least(256, ceil(event_id % 128 / 128 * 256 - 4 + event_id % 16 / 128 * 256 + 8)) AS x2, least(128, ceil(event_id % 64 / 64 * 128 - 4 + event_id % 8 / 64 * 128 + 8)) AS y2,
  CASE WHEN event_id % 2 = 0 THEN value / 500 ELSE 0 END AS confidence FROM frames)
SELECT source_id, frame, 'qr_code' AS kind, 'needs_review' AS status, 'qr_payload_not_retained' AS reason, CAST(x1 AS BIGINT) AS x, CAST(y1 AS BIGINT) AS y, CAST(x2 - x1 AS BIGINT) AS w, CAST(y2 - y1 AS BIGINT) AS h, confidence FROM b WHERE x2 > x1 AND y2 > y1""",
    "srt_segments": f"WITH {_SAID} SELECT * FROM s",
    "srt_window": f"WITH {_SAID} SELECT * REPLACE (greatest(start_ms + 500, 61000) AS start_ms, least(end_ms + 500, 130000) AS end_ms) FROM s WHERE end_ms + 500 > 61000 AND start_ms + 500 < 130000",
    "published_timeline": f"""WITH iv AS ({_with("role = 'local_redaction'")})
SELECT source_id, ordinal, printf('| %d | %s–%s | %s–%s |', ordinal, {_stamp("start_frame")}, {_stamp("end_frame")}, {_stamp("source_start")}, {_stamp("source_end")}) AS line FROM iv""",
}
