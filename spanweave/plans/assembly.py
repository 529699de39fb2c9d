"""Queries of assembly: chunks, plans over baselines, windows, findings of several channels and checks of the whole."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import assembly as op
from ..operators import detection, intervals
from ..sources import derived
from .intervals import RUNS, _gaps, _runs
from .oracle_views import EVENTS, FRAMES, REGIONS

#: Frames of a part.
PART = 9


def _local(df):
    """part and the frame within it."""
    return df.withColumns({"part": F.floor(F.col("frame") / PART).cast("bigint"), "frame": F.col("frame") % PART})


def _parts(spark, d):
    f = _local(derived.frames(spark, d))
    return f.groupBy("source_id", "part").agg((F.first("part") * PART).alias("start_frame"), F.count("*").alias("frames"))


def chunk_errors(spark, d):
    """Parts of which some begin late, differ in rate or size, promise a frame too many, or have a record out of place."""
    s, p = F.col("source_id"), F.col("part")
    odd = lambda c: F.when(c, 1).otherwise(0)
    parts = _parts(spark, d).withColumns({
        "start_frame": F.col("start_frame") + odd((p == 3) & (s % 2 == 1)), "rate": 30 - odd((p == 2) & (s % 3 == 0)), "width": 1920 - odd((p == 1) & (s % 5 == 0)), "height": F.lit(1080),
        "frames": F.col("frames") + odd((p == 4) & (s % 7 == 0)),
    })
    records = _local(derived.frames(spark, d)).withColumn("frame", F.col("frame") + 50 * odd((p == 5) & (s % 4 == 0) & (F.col("frame") == 0)))
    return op.chunk_errors(parts, records)


def merged_chunks(spark, d):
    return op.merge_chunks(_parts(spark, d), _local(derived.regions(spark, d))).select("source_id", "part", "frame", "ord", "region_id", *"xywh")


def chunk_cut_edges(spark, d):
    return op.chunk_cuts(_parts(spark, d), _local(derived.frames(spark, d).where("event_id % 17 = 0")))


def part_totals(spark, d):
    return op.part_totals(_parts(spark, d), _local(derived.regions(spark, d)), ["ocr", "tracked", "backfilled"])


def _touching(spark, d):
    from pyspark.sql import Window

    out = intervals.merge_gaps(derived.events(spark, d), ["source_id"], 0)
    return out.select("source_id", "start", "end", F.row_number().over(Window.partitionBy("source_id").orderBy("start")).cast("bigint").alias("ordinal"))


def interval_at_frame(spark, d):
    points = derived.frames(spark, d).select("source_id", (F.col("frame") * 23).alias("frame"))
    return op.containing(points, _touching(spark, d), "source_id", "ordinal").select("source_id", "frame", "ordinal")


def events_in_windows(spark, d):
    windows = intervals.activity_windows(_runs(spark, d), ["source_id"], 3).select("source_id", "start", "end")
    events = derived.events(spark, d).select("source_id", "event_id", (F.col("start") % 700).alias("start"), (F.col("start") % 700 + F.col("end") - F.col("start")).alias("end"))
    met = op.overlapping(events, windows, "source_id")
    return met.select("source_id", "event.event_id", F.col("window.start").alias("window_start"), F.col("window.end").alias("window_end"))


def plan_over_baseline(spark, d):
    plan = derived.events(spark, d).where("role = 'overlay'").select("source_id", F.concat(F.lit("plan-"), F.col("event_id")).alias("region_id"), "start", "end", *[F.lit(i).cast("bigint").alias(c) for i, c in enumerate("xywh", 5)])
    return op.with_baseline(plan, derived.regions(spark, d), F.col("source_id") * 10).select("source_id", "region_id", F.col("start").alias("start_frame"), F.col("end").alias("end_frame"), *"xywh")


def interval_mismatches(spark, d):
    rows = _touching(spark, d)
    o = F.col("ordinal")
    supplied = rows.withColumns({"end": F.col("end") + F.when(o % 7 == 0, 1).otherwise(0), "ordinal": F.when(o % 11 == 0, o + 100000).otherwise(o)})
    return op.interval_mismatches(rows, supplied, "source_id", ["start", "end"])


def _codes(spark, d):
    e = F.col("event_id")
    return derived.frames(spark, d).select("source_id", "frame", F.struct((e % 128 / 128).alias("x"), (e % 64 / 64).alias("y"), (e % 16 / 128).alias("w"), (e % 8 / 64).alias("h")).alias("box"))


def code_masks(spark, d):
    out = op.code_masks(_codes(spark, d), 256, 128)
    return out.select("source_id", "frame", "kind", "status", "reason", "confidence", *[F.col(f"pixel_box.{c}").alias(c) for c in "xywh"])


def event_categories(spark, d):
    e = F.col("event_id")
    rows = derived.events(spark, d).withColumn("category", F.when(e % 4 == 0, F.concat("category", F.lit("!"))).when(e % 4 == 1, F.lit(None)).when(e % 4 == 2, F.initcap("category")).otherwise(F.col("category")))
    return op.event_category(rows).select("source_id", "event_id", "category")


def _heard(spark, d):
    rows = derived.table(spark, d, "conversations").select("conv_id", "turn", F.format_string("%d: see notes.md, shop%d.org or email", F.col("turn"), F.col("conv_id")).alias("text"))
    return op.heard(rows, "subtitle")


def heard_findings(spark, d):
    return _heard(spark, d).select("conv_id", "turn", "channel", "kind", "status", "reason")


def findings_by_channel(spark, d):
    both = op.findings(op.code_masks(_codes(spark, d), 256, 128).withColumn("channel", F.lit("screen")), _heard(spark, d))
    return both.groupBy("channel", "kind", "status").agg(F.count("*").alias("n"), F.count("frame").alias("with_frame"))


def removed_ids_present(spark, d):
    ids = op.merge_chunks(_parts(spark, d), _local(derived.regions(spark, d)))
    removed = derived.table(spark, d, "region").select(F.format_string("P%02d:U%d", F.col("r_regionkey"), F.col("r_regionkey") * 2).alias("region_id"))
    return op.still_there(ids, removed)


def area_share_ranges(spark, d):
    return op.area_shares(derived.regions(spark, d), ["source_id", "region_id"], 1920, 1080)


def synthetic_acceptance(spark, d):
    e = F.col("event_id")
    coverage = F.transform(F.sequence(F.lit(1), F.lit(3)), lambda i: 1 - (e * i % 64 == 0).cast("int") / 32)
    rows = derived.frames(spark, d).select("source_id", F.when(e % 3 == 0, F.slice(coverage, 1, 0)).otherwise(coverage).alias("coverage"), F.when(e % 100 == 0, 0.01).otherwise(0.0).alias("normal_changed"), (e % 105).alias("changed_pixels"))
    out = op.acceptance(rows, "source_id")
    return out.select("source_id", "frames", F.round("mean_coverage", 9).alias("mean_coverage"), "least_coverage", "missed", F.col("normal_changed").alias("normal_frames"), "stale", "passed")


def search_page(spark, d):
    docs = derived.table(spark, d, "documents").select("doc_id", "lang", F.coalesce("text", F.lit("")).alias("text"))
    return op.page(docs, ["doc_id"], 1, 60, "ETh").select("doc_id", "lang")


def preview_frames(spark, d):
    return op.previews(derived.frames(spark, d), "source_id")


def masked_spans_only(spark, d):
    rows = derived.table(spark, d, "part").select("p_partkey", F.format_string("notes%d.md 3.shop.com www.shop%d.org", F.col("p_partkey"), F.col("p_partkey")).alias("text"))
    out = op.masked_only(detection.detect(rows))
    return out.select("p_partkey", F.size("spans").alias("n"), F.col("spans")[0]["start"].cast("bigint").alias("start_char"))


QUERIES = {f.__name__: f for f in (chunk_errors, merged_chunks, chunk_cut_edges, part_totals, interval_at_frame, events_in_windows, plan_over_baseline, interval_mismatches, code_masks, event_categories, heard_findings, findings_by_channel, removed_ids_present, area_share_ranges, synthetic_acceptance, search_page, preview_frames, masked_spans_only)}

_TOUCH = f"{EVENTS}, {_gaps('ev', 0)}, touch AS (SELECT source_id, s, e, row_number() OVER (PARTITION BY source_id ORDER BY s) AS ordinal FROM merged)"
_CODES = """b AS (SELECT source_id, frame, event_id % 16 AS cw, event_id % 8 AS ch, greatest(0, floor(event_id % 128 / 128 * 256 - 4)) AS x1, greatest(0, floor(event_id % 64 / 64 * 128 - 4)) AS y1, least(256, ceil(event_id % 128 / 128 * 256 - 4 + event_id % 16 / 128 * 256 + 8)) AS x2, least(128, ceil(event_id % 64 / 64 * 128 - 4 + event_id % 8 / 64 * 128 + 8)) AS y2 FROM frames),
codes AS (SELECT * FROM b WHERE cw > 0 AND ch > 0 AND x2 > x1 AND y2 > y1)"""

ORACLES = {
    "chunk_errors": f"""WITH {FRAMES}, p AS (SELECT source_id, frame // 9 AS part, count(*) AS n, min(frame) AS low FROM frames GROUP BY 1, 2),
q AS (SELECT *, low + CASE WHEN part = 3 AND source_id % 2 = 1 THEN 1 ELSE 0 END AS start_frame, n + CASE WHEN part = 4 AND source_id % 7 = 0 THEN 1 ELSE 0 END AS frames FROM p),
r AS (SELECT *, coalesce(sum(frames) OVER (PARTITION BY source_id ORDER BY part ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM q)
SELECT source_id, part, 'start' AS fault FROM r WHERE start_frame <> before UNION ALL SELECT source_id, part, 'rate' FROM r WHERE part = 2 AND source_id % 3 = 0 UNION ALL SELECT source_id, part, 'size' FROM r WHERE part = 1 AND source_id % 5 = 0
UNION ALL SELECT source_id, part, 'count' FROM r WHERE n <> frames UNION ALL SELECT source_id, part, 'order' FROM r WHERE part = 5 AND source_id % 4 = 0""",
    "merged_chunks": f"WITH {REGIONS} SELECT source_id, frame // 9 AS part, frame, ord, printf('P%02d:', frame // 9) || region_id AS region_id, x, y, w, h FROM regions",
    "chunk_cut_edges": f"WITH {FRAMES} SELECT DISTINCT source_id, frame FROM frames WHERE event_id % 17 = 0 OR (frame > 0 AND frame % 9 = 0)",
    "part_totals": f"""WITH {REGIONS}, p AS (SELECT source_id, frame // 9 AS part, count(*) AS frames FROM frames GROUP BY 1, 2)
SELECT p.source_id, p.part, p.frames, count(DISTINCT frame) AS masked_frames, count(*) FILTER (origin = 'ocr') AS ocr, count(*) FILTER (origin = 'tracked') AS tracked, count(*) FILTER (origin = 'backfilled') AS backfilled FROM p LEFT JOIN regions r ON r.source_id = p.source_id AND r.frame // 9 = p.part GROUP BY ALL""",
    "interval_at_frame": f"WITH {FRAMES}, {_TOUCH} SELECT f.source_id, f.frame * 23 AS frame, t.ordinal FROM frames f LEFT JOIN touch t ON t.source_id = f.source_id AND t.s <= f.frame * 23 AND f.frame * 23 < t.e",
    "events_in_windows": f"""WITH {RUNS}, {_gaps('runs', 3)}, {EVENTS} SELECT v.source_id, v.event_id, m.s AS window_start, m.e AS window_end FROM ev v JOIN merged m ON m.source_id = v.source_id AND v.s % 700 < m.e AND v.s % 700 + v.e - v.s > m.s""",
    "plan_over_baseline": f"""WITH {REGIONS}, {EVENTS} SELECT source_id, 'plan-' || event_id AS region_id, s AS start_frame, e AS end_frame, CAST(5 AS BIGINT) AS x, CAST(6 AS BIGINT) AS y, CAST(7 AS BIGINT) AS w, CAST(8 AS BIGINT) AS h FROM ev WHERE role = 'overlay'
UNION ALL SELECT source_id, printf('baseline-%d-%d', source_id * 10 + frame, ord), source_id * 10 + frame, source_id * 10 + frame + 1, x, y, w, h FROM regions""",
    "interval_mismatches": f"""WITH {_TOUCH} SELECT source_id, ordinal, false AS only_supplied, ordinal % 11 = 0 AS only_rebuilt FROM touch WHERE ordinal % 7 = 0 OR ordinal % 11 = 0 UNION ALL SELECT source_id, ordinal + 100000, true, false FROM touch WHERE ordinal % 11 = 0""",
    "code_masks": f"WITH {FRAMES}, {_CODES} SELECT source_id, frame, 'qr_code' AS kind, 'mask' AS status, 'privacy_qr_code' AS reason, 1.0::DOUBLE AS confidence, CAST(x1 AS BIGINT) AS x, CAST(y1 AS BIGINT) AS y, CAST(x2 - x1 AS BIGINT) AS w, CAST(y2 - y1 AS BIGINT) AS h FROM codes",
    "event_categories": f"WITH {EVENTS} SELECT source_id, event_id, CASE WHEN event_id % 4 = 3 THEN category ELSE 'local' END AS category FROM ev WHERE role = 'local_redaction'",
    "heard_findings": "SELECT conv_id, turn, 'subtitle' AS channel, kind, 'needs_review' AS status, CASE kind WHEN 'domain' THEN 'visible_address' ELSE 'spoken_contact_context_required' END AS reason FROM conversations, (VALUES ('domain'), ('contact_cue')) k(kind)",
    "findings_by_channel": f"""WITH {FRAMES}, {_CODES} SELECT 'screen' AS channel, 'qr_code' AS kind, 'mask' AS status, count(*) AS n, count(*) AS with_frame FROM codes
UNION ALL SELECT 'subtitle', kind, 'needs_review', count(*), 0 FROM conversations, (VALUES ('domain'), ('contact_cue')) k(kind) GROUP BY kind""",
    "removed_ids_present": f"WITH {REGIONS} SELECT DISTINCT printf('P%02d:', frame // 9) || region_id AS region_id FROM regions INTERSECT SELECT printf('P%02d:U%d', r_regionkey, r_regionkey * 2) FROM region",
    "area_share_ranges": f"WITH {REGIONS} SELECT source_id, region_id, round_even(min(100 * w * h / (1920 * 1080)), 4) AS least_percent, round_even(max(100 * w * h / (1920 * 1080)), 4) AS most_percent FROM regions GROUP BY 1, 2",
    "synthetic_acceptance": f"""WITH {FRAMES}, l AS (SELECT source_id, event_id, CASE WHEN event_id * i % 64 = 0 THEN 0.96875::DOUBLE ELSE 1.0::DOUBLE END AS c FROM frames, range(1, 4) t(i) WHERE event_id % 3 <> 0),
a AS (SELECT source_id, round(avg(c), 9) AS mean_coverage, min(c) AS least_coverage, count(DISTINCT event_id) FILTER (c < 0.98) AS missed FROM l GROUP BY 1),
f AS (SELECT source_id, count(*) AS frames, count(*) FILTER (event_id % 100 = 0) AS normal_frames, count(*) FILTER (event_id % 3 = 0 AND event_id % 105 > 100) AS stale FROM frames GROUP BY 1)
SELECT f.source_id, frames, mean_coverage, least_coverage, coalesce(missed, 0) AS missed, normal_frames, stale, coalesce(missed, 0) = 0 AND normal_frames = 0 AND stale = 0 AS passed FROM f LEFT JOIN a USING (source_id)""",
    "search_page": "SELECT doc_id, lang FROM documents WHERE contains(lower(coalesce(text, '')), 'eth') ORDER BY doc_id LIMIT 60 OFFSET 60",
    "preview_frames": f"WITH {FRAMES}, n AS (SELECT source_id, greatest(1, CAST(round_even(count(*) / 10, 0) AS BIGINT)) AS step FROM frames GROUP BY 1) SELECT f.source_id, f.frame FROM frames f JOIN n USING (source_id) WHERE f.frame % step = 0 AND f.frame < 12 * step",
    "masked_spans_only": "SELECT p_partkey, CAST(1 AS INT) AS n, CAST(20 + length(CAST(p_partkey AS VARCHAR)) AS BIGINT) AS start_char FROM part",
}
