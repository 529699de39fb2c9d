"""Queries of the interval algebra."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import intervals as op
from ..sources import derived
from .oracle_views import CUTS, EVENTS, FRAMES

MASKED = "event_type IN ('click', 'purchase', 'error')"


def _runs(spark, d):
    return op.runs(derived.frames(spark, d), F.expr(MASKED), ["source_id"])


RUNS = f"""{FRAMES}, isl AS (SELECT *, frame - row_number() OVER (PARTITION BY source_id ORDER BY frame) AS g FROM frames WHERE {MASKED}),
runs AS (SELECT source_id, min(frame) AS s, max(frame) + 1 AS e FROM isl GROUP BY source_id, g)"""


def _gaps(rows: str, gap: int, by: str = "source_id", extra: str = "") -> str:
    """SQL that merges rows (source_id, s, e) over gaps."""
    return f"""lagged AS (SELECT *, max(e) OVER (PARTITION BY {by} ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS b FROM {rows}),
grp AS (SELECT *, sum(CASE WHEN b IS NULL OR s - b > {gap} THEN 1 ELSE 0 END) OVER (PARTITION BY {by} ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS g FROM lagged),
merged AS (SELECT {by}, min(s) AS s, max(e) AS e{extra} FROM grp GROUP BY {by}, g)"""


def frame_runs(spark, d):
    return _runs(spark, d).select("source_id", F.col("start").alias("start_frame"), F.col("end").alias("end_frame"))


def gap_merged_segments(spark, d):
    return op.merge_gaps(_runs(spark, d), ["source_id"], 2).select("source_id", F.col("start").alias("start_frame"), F.col("end").alias("end_frame"))


def interval_merge_touching(spark, d):
    rows = derived.events(spark, d).where("role = 'local_redaction'")
    return op.merge_gaps(rows, ["source_id"], 0, [F.count("*").alias("n")]).select("source_id", F.col("start").alias("start_frame"), F.col("end").alias("end_frame"), "n")


def interval_merge_cuts(spark, d):
    rows = derived.events(spark, d).where("role = 'local_redaction'")
    out = op.merge_at_cuts(rows, derived.cuts(spark, d), "source_id")
    return out.select("source_id", F.col("ordinal").cast("bigint").alias("ordinal"), F.col("start").alias("start_frame"), F.col("end").alias("end_frame"), F.array_join("events", ",").alias("events"), "source_start", "source_end")


_AT_CUTS = f"""{EVENTS}, {CUTS},
edge AS (SELECT event_id, source_id, s AS pos FROM sel UNION SELECT event_id, source_id, e FROM sel
  UNION SELECT sel.event_id, sel.source_id, boundary FROM sel JOIN cuts USING (source_id) WHERE boundary > s AND boundary < e),
piece AS (SELECT source_id, event_id, pos AS s, lead(pos) OVER (PARTITION BY source_id, event_id ORDER BY pos) AS e FROM edge),
cutno AS (SELECT p.source_id, p.event_id, p.s, p.e, count(c.boundary) AS cut FROM piece p LEFT JOIN cuts c ON c.source_id = p.source_id AND c.boundary <= p.s
  WHERE p.e IS NOT NULL GROUP BY ALL),
{_gaps("cutno", 0, "source_id, cut", ", string_agg(DISTINCT event_id, ',' ORDER BY event_id) AS events")}
SELECT m.source_id, row_number() OVER (PARTITION BY m.source_id ORDER BY m.s) AS ordinal, m.s AS start_frame, m.e AS end_frame, m.events,
  CAST(m.s + coalesce((SELECT sum(len) FROM cuts c WHERE c.source_id = m.source_id AND c.boundary <= m.s), 0) AS BIGINT) AS source_start,
  CAST(m.e + coalesce((SELECT sum(len) FROM cuts c WHERE c.source_id = m.source_id AND c.boundary <= m.e - 1), 0) AS BIGINT) AS source_end
FROM merged m"""


def _with(select: str) -> str:
    return "WITH " + _AT_CUTS.replace(f"{EVENTS}, {CUTS},", f"{EVENTS}, {CUTS}, sel AS (SELECT * FROM ev WHERE {select}),")


def category_intervals(spark, d):
    rows = derived.events(spark, d).where("role = 'local_redaction' AND category IN ('click', 'view')")
    out = op.merge_at_cuts(rows, derived.cuts(spark, d), "source_id")
    return out.select("source_id", F.col("ordinal").cast("bigint").alias("ordinal"), F.col("start").alias("start_frame"), F.col("end").alias("end_frame"), F.array_join("events", ",").alias("events"), "source_start", "source_end")


def activity_windows_topk(spark, d):
    out = op.activity_windows(_runs(spark, d), ["source_id"], 3)
    rows = out.select("source_id", F.col("start").alias("start_frame"), F.col("end").alias("end_frame"), F.col("active_frames").cast("bigint").alias("active_frames"), "intervals")
    return rows.orderBy(F.desc("active_frames"), "source_id", "start_frame").limit(30)


def segment_catalog_offsets(spark, d):
    runs = _runs(spark, d)
    out = op.catalog(op.merge_gaps(runs, ["source_id"], 2), runs, "source_id")
    return out.withColumnsRenamed({"start": "start_frame", "end": "end_frame"}).withColumn("segment", F.col("segment").cast("bigint"))


_CATALOG = f"""{RUNS}, {_gaps("runs", 2, extra=", CAST(sum(e - s) AS BIGINT) AS masked_frames")},
cat AS (SELECT source_id, row_number() OVER w AS segment, s AS start_frame, e AS end_frame, e - s AS frames,
  CAST(coalesce(sum(e - s) OVER (PARTITION BY source_id ORDER BY s ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS collection_start, masked_frames
  FROM merged WINDOW w AS (PARTITION BY source_id ORDER BY s))"""


def frame_mapping(spark, d):
    runs = _runs(spark, d)
    out = op.frame_mapping(op.catalog(op.merge_gaps(runs, ["source_id"], 2), runs, "source_id"), "source_id")
    return out.withColumn("segment", F.col("segment").cast("bigint"))


def source_cut_mapping(spark, d):
    rows = op.with_cuts(derived.frames(spark, d).select("source_id", (F.col("frame") * 23).alias("frame")), derived.cuts(spark, d), "source_id")
    return rows.select("source_id", "frame", op.to_source(F.col("frame"), F.col("cuts")).alias("source_frame"))


def source_cut_inverse(spark, d):
    rows = op.with_cuts(derived.frames(spark, d).select("source_id", (F.col("frame") * 3 + 90).alias("source_frame")), derived.cuts(spark, d), "source_id")
    return rows.select("source_id", "source_frame", op.to_output(F.col("source_frame"), F.col("cuts")).alias("frame"))


def gapped(frame):
    """Frame numbers with a gap after each nine."""
    return frame + F.floor(frame / 9).cast("bigint")


def keyframe_asof_windows(spark, d):
    f = derived.frames(spark, d)
    ends = f.groupBy("source_id").agg(F.count("*").alias("n_frames"))
    out = op.keyframe_windows(f.where("event_id % 13 = 0"), f.where("frame % 10 = 0"), ends, "source_id")
    return out.select("source_id", F.col("start").alias("start_frame"), F.col("end").alias("end_frame"))


def segment_boundaries(spark, d):
    f = derived.frames(spark, d).withColumn("frame", gapped(F.col("frame")))
    out = op.segments(f, "source_id", F.col("event_id") % 17 == 0)
    return out.select("source_id", F.col("segment").cast("bigint").alias("segment"), F.col("start").alias("start_frame"), F.col("end").alias("end_frame"), "n_frames")


def frame_index_faults(spark, d):
    return op.index_faults(derived.frames(spark, d).withColumn("frame", gapped(F.col("frame"))), "source_id")


def interval_checkpoints(spark, d):
    out = op.checkpoints(op.merge_gaps(_runs(spark, d), ["source_id"], 2), 5)
    return out.select("source_id", F.col("start").alias("start_frame"), F.array_join("checkpoints", ",").alias("checkpoints"))


def short_gap_candidates(spark, d):
    return op.short_gaps(derived.frames(spark, d).where(MASKED), ["source_id"], 9)


def interval_faults(spark, d):
    out = op.bad_intervals(derived.events(spark, d), ["source_id"])
    return out.select("source_id", "event_id", F.col("start").alias("start_frame"), F.col("end").alias("end_frame"))


QUERIES = {f.__name__: f for f in (frame_runs, gap_merged_segments, interval_merge_touching, interval_merge_cuts, category_intervals, activity_windows_topk, segment_catalog_offsets, frame_mapping, source_cut_mapping, source_cut_inverse, keyframe_asof_windows, segment_boundaries, frame_index_faults, interval_checkpoints, short_gap_candidates, interval_faults)}

ORACLES = {
    "frame_runs": f"WITH {RUNS} SELECT source_id, s AS start_frame, e AS end_frame FROM runs",
    "gap_merged_segments": f"WITH {RUNS}, {_gaps('runs', 2)} SELECT source_id, s AS start_frame, e AS end_frame FROM merged",
    "interval_merge_touching": f"WITH {EVENTS}, sel AS (SELECT * FROM ev WHERE role = 'local_redaction'), {_gaps('sel', 0, extra=', count(*) AS n')} SELECT source_id, s AS start_frame, e AS end_frame, n FROM merged",
    "interval_merge_cuts": _with("role = 'local_redaction'"),
    "category_intervals": _with("role = 'local_redaction' AND category IN ('click', 'view')"),
    "activity_windows_topk": f"WITH {RUNS}, {_gaps('runs', 3, extra=', CAST(sum(e - s) AS BIGINT) AS active_frames, count(*) AS intervals')} SELECT source_id, s AS start_frame, e AS end_frame, active_frames, intervals FROM merged ORDER BY active_frames DESC, source_id, s LIMIT 30",
    "segment_catalog_offsets": f"WITH {_CATALOG} SELECT source_id, segment, start_frame, end_frame, frames, collection_start, collection_start + frames AS collection_end, masked_frames, frames - masked_frames AS context_frames FROM cat",
    "frame_mapping": f"WITH {_CATALOG} SELECT source_id, segment, i AS segment_frame, collection_start + i AS collection_frame, start_frame + i AS source_frame FROM cat, range(0, 1000) t(i) WHERE i < frames",
    "source_cut_mapping": f"WITH {FRAMES}, {CUTS}, f AS (SELECT source_id, frame * 23 AS frame FROM frames) SELECT source_id, frame, CAST(frame + coalesce((SELECT sum(len) FROM cuts c WHERE c.source_id = f.source_id AND c.boundary <= f.frame), 0) AS BIGINT) AS source_frame FROM f",
    "source_cut_inverse": f"""WITH {FRAMES}, {CUTS}, f AS (SELECT source_id, frame * 3 + 90 AS sf FROM frames)
SELECT source_id, sf AS source_frame, CASE WHEN EXISTS (SELECT 1 FROM cuts c WHERE c.source_id = f.source_id AND c.a <= f.sf AND f.sf < c.b) THEN NULL
  ELSE CAST(sf - coalesce((SELECT sum(len) FROM cuts c WHERE c.source_id = f.source_id AND c.a <= f.sf), 0) AS BIGINT) END AS frame FROM f""",
    "keyframe_asof_windows": f"""WITH {FRAMES}, sel AS (SELECT DISTINCT f.source_id, coalesce((SELECT max(k.frame) FROM frames k WHERE k.source_id = f.source_id AND k.frame % 10 = 0 AND k.frame <= f.frame), 0) AS s,
  coalesce((SELECT min(k.frame) FROM frames k WHERE k.source_id = f.source_id AND k.frame % 10 = 0 AND k.frame > f.frame), (SELECT count(*) FROM frames k WHERE k.source_id = f.source_id)) AS e FROM frames f WHERE event_id % 13 = 0), {_gaps('sel', 0)}
SELECT source_id, s AS start_frame, e AS end_frame FROM merged""",
    "segment_boundaries": f"""WITH {FRAMES}, x AS (SELECT source_id, event_id, frame + frame // 9 AS frame FROM frames), f AS (SELECT *, lag(frame) OVER (PARTITION BY source_id ORDER BY frame) AS p FROM x),
g AS (SELECT *, sum(CASE WHEN p IS NULL OR frame <> p + 1 OR event_id % 17 = 0 THEN 1 ELSE 0 END) OVER (PARTITION BY source_id ORDER BY frame) AS segment FROM f)
SELECT source_id, CAST(segment AS BIGINT) AS segment, min(frame) AS start_frame, max(frame) + 1 AS end_frame, count(*) AS n_frames FROM g GROUP BY source_id, segment""",
    "frame_index_faults": f"WITH {FRAMES}, x AS (SELECT source_id, frame + frame // 9 AS frame FROM frames), f AS (SELECT source_id, frame, coalesce(lag(frame) OVER (PARTITION BY source_id ORDER BY frame) + 1, 0) AS expected FROM x) SELECT * FROM f WHERE frame <> expected",
    "interval_checkpoints": f"""WITH {RUNS}, {_gaps('runs', 2)}
SELECT source_id, s AS start_frame, array_to_string(list_sort(list_distinct(list_concat(range(s, e, 5), [(s + e - 1) // 2, e - 1]))), ',') AS checkpoints FROM merged""",
    "short_gap_candidates": f"WITH {FRAMES}, f AS (SELECT source_id, frame, lead(frame) OVER (PARTITION BY source_id ORDER BY frame) AS next_frame FROM frames WHERE {MASKED}) SELECT source_id, frame, next_frame, next_frame - frame AS gap FROM f WHERE next_frame - frame > 1 AND next_frame - frame <= 9",
    "interval_faults": f"WITH {EVENTS}, f AS (SELECT *, max(e) OVER (PARTITION BY source_id ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS b FROM ev) SELECT source_id, event_id, s AS start_frame, e AS end_frame FROM f WHERE s >= e OR s < b",
}
