"""Subtitles, reports, patches, audit, tracking and the stream, on small tables."""

import json
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from spanweave.functions import boxes, clock
from spanweave.operators import audit, patches, tracking
from spanweave.sources import reports, subtitles
from spanweave.streaming.backfill import backfill_batch


def test_srt(spark):
    text = "1\n00:00:01,500 --> 00:00:02,500\nhello\nthere\n\n00:01:00.000 --> 00:01:01.000\nx\n\n3\n00:61:00,000 --> 00:61:01,000\nbad\n\nno time\n"
    rows = subtitles.segments(spark.createDataFrame([("a", text), ("b", ""), ("c", "\r\n\r\n")], "source_id string, content string")).orderBy("seq").collect()
    assert [(r.start_ms, r.end_ms, r.text, r.valid) for r in rows[:2]] == [(1500, 2500, "hello\nthere", True), (60000, 61000, "x", True)]
    assert [r.valid for r in rows[2:]] == [False, False]
    good = subtitles.segments(spark.createDataFrame([("a", text)], "source_id string, content string")).where("valid")
    assert [(r.start_ms, r.end_ms) for r in subtitles.in_window(good, 2000, 4000).collect()] == [(2000, 2500)]


def report(**change):
    base = {"status": "complete", "width": 100, "height": 80, "fps": 30.0, "processed_frames": 2, "scene_cuts": [], "frames": [
        {"frame": 0, "time": 0.0, "boxes": [[1, 2, 3, 4]], "origins": ["ocr"], "regions": [{"id": "U001", "kind": "www"}]}, {"frame": 1, "time": 0.1, "boxes": [], "origins": [], "regions": []}]}
    return base | change


@pytest.mark.parametrize(
    ("change", "fault"),
    [({}, None), ({"status": "failed"}, "not_complete"), ({"processed_frames": 3}, "frame_count"), ({"fps": 0.5}, "bad_rate"), ({"width": 3}, "box_outside")],
)
def test_report_faults(spark, tmp_path, change, fault):
    (tmp_path / "report.json").write_text(json.dumps(report(**change)))
    read = reports.read_reports(spark, str(tmp_path))
    assert [r.fault for r in reports.faults(read).collect()] == ([fault] if fault else [])
    assert [(r.frame, r.x, r.h, r.region_id) for r in reports.regions(read).collect()] == [(0, 1, 4, "U001")]
    assert reports.file_catalog(spark, str(tmp_path)).count() == 1


def region(spark, rows):
    return spark.createDataFrame(rows, "source_id bigint, frame bigint, ord bigint, region_id string, x bigint, y bigint, w bigint, h bigint, origin string")


def test_patch_is_idempotent(spark):
    base = region(spark, [(1, 0, 0, "a", 1, 1, 5, 5, "ocr"), (1, 1, 0, "b", 1, 1, 5, 5, "ocr")])
    add = region(spark, [(1, 1, 1, "n", 2, 2, 5, 5, "human_review")])
    once = patches.add_remove(base, base.where("region_id = 'a'"), add, "R0")
    assert patches.unequal(once, patches.add_remove(once, base.where("region_id = 'a'"), add, "R0")).count() == 0
    assert tuple(patches.delta(base, once).first()) == (1, 1, 2, 1, 0, 1)


def test_boxes(spark):
    one = spark.range(1).select(boxes.clamp(F.lit(10.0) - 4, F.lit(20.0) - 4, F.lit(30.0) + 8, F.lit(40.0) + 8, 100, 100).alias("b"), boxes.box(F.lit(0), F.lit(0), F.lit(4), F.lit(4)).alias("c"))
    assert tuple(one.first().b) == (6, 16, 38, 48)
    assert one.select(boxes.valid(F.col("c"), 4, 4), boxes.valid(F.col("c"), 3, 4), boxes.iou(F.col("c"), F.col("c"))).first()[:] == (True, False, 1.0)
    assert len(one.select(boxes.subtract(F.col("c"), boxes.box(F.lit(1), F.lit(1), F.lit(2), F.lit(2)))).first()[0]) == 4


def test_times(spark):
    row = spark.range(1).select(clock.minutes(F.lit(61234)), clock.hours(F.lit(3661234)), clock.frame_boundary(F.lit(0.1 + 0.2), F.lit(10), F.lit(1)), clock.frame_boundary(F.lit(0.45), F.lit(10), F.lit(1)), clock.frame_boundary(F.lit(199.666667), F.lit(30), F.lit(1), 5e-7))
    assert tuple(row.first()) == ("01:01.234", "01:01:01.234", 3, 5, 5990)
    # A time that was given as it is keeps its part of a frame; no precision makes 1e-4 of a frame noise.
    given = [clock.frame_boundary(F.lit(t), F.lit(30), F.lit(1), p) for t, p in ((199.666667, 0.0), (1 + 1e-6, 0.0), (1 + 1e-5, 1.0), (0.0, 0.0), (1 + 3e-6, 1.0))]
    assert tuple(spark.range(1).select(*given).first()) == (5991, 31, 31, 0, 30)


def test_coverage_precedence(spark):
    frames = spark.createDataFrame([(1, i, "failed" if i == 5 else "checked", False) for i in range(20)] + [(2, 0, "checked", True)], "source_id bigint, frame bigint, state string, hit boolean")
    expected = spark.createDataFrame([(1, 20, 0), (2, 1, 0), (3, 4, 0)], "source_id bigint, expected_frames bigint, decoder_exit int")
    out = {r.source_id: (r.checked_frames, r.failed_frames, r.failure_code, r.result) for r in audit.coverage(frames, expected).collect()}
    assert out == {1: (19, 1, "ocr_coverage_incomplete", "failed"), 2: (1, 0, None, "hits"), 3: (0, 0, "decoded_coverage_incomplete", "failed")}


def test_silence_is_exact(spark):
    rows = spark.createDataFrame([(1, 0.0), (1, 1e-12), (2, 0.0), (3, float("nan"))], "k int, sample double")
    assert {r.k: r.silent for r in audit.digital_silence(rows, "k").collect()} == {1: False, 2: True, 3: False}


def test_tracks_and_runs():
    still = np.array([(100, 50, 40, 20)] * 8)
    assert list(tracking.track_runs(still)) == [("static", 0, 8)]
    moving = np.array([(100 + 20 * i, 50, 40, 20) for i in range(5)])
    assert list(tracking.track_runs(np.concatenate([moving, [(190, 50, 40, 20)] * 6]))) == [("moving", 0, 5), ("static", 5, 11)]
    for mode, a, b in tracking.track_runs(moving):
        for box, wide in zip(moving[a:b], tracking.envelope(moving[a:b], mode, 400, 400), strict=True):
            assert wide[0] <= box[0] and wide[0] + wide[2] >= box[0] + box[2]


def joined(boxes, word=(), fixed=(), trusted=(), detected=()):
    flags = [np.isin(np.arange(len(boxes)), x) for x in (word, fixed, trusted, detected)]
    return [(tuple(b.tolist()), j, u) for b, j, u in tracking.join_frame(np.array(boxes), *flags)]


def test_boxes_of_a_frame_are_joined_along_rows():
    three = [(0, 0, 10, 10), (5, 0, 10, 10), (50, 50, 5, 5)]
    assert joined(three) == [((0, 0, 15, 10), [0, 1], []), ((50, 50, 5, 5), [2], [])]
    assert joined(three, fixed=[1]) == [(b, [k], []) for k, b in enumerate(three)]
    assert joined(three, word=[0]) == [(b, [k], []) for k, b in enumerate(three)]
    # A trusted row takes the place of a detected one that it spans; a word never gives way.
    assert joined(three, trusted=[1], detected=[0, 2]) == [((5, 0, 10, 10), [1], [0]), ((50, 50, 5, 5), [2], [])]
    assert joined([(0, 0, 10, 10), (0, 0, 30, 10)], trusted=[0], detected=[1]) == [((0, 0, 30, 10), [0, 1], [])]
    assert len(joined(three, trusted=[1], detected=[0], word=[0])) == 3
    # What was joined may lie on a row with a third.
    assert joined([(0, 0, 10, 10), (8, 0, 10, 10), (5, 0, 10, 10)]) == [((0, 0, 18, 10), [0, 2, 1], [])]


def brute_tracks(frames):
    """Greedy association by its definition, over lists of (frame, box, ids, word, fixed, caption)."""
    out, live, n = [], [], 0
    for at, rows in frames:
        live = [x for x in live if x[0] == at - 1]
        pairs = []
        for i, (b, ids, *flags) in enumerate(rows):
            for _, track, old, names, *before in live:
                common = max(0, min(b[0] + b[2], old[0] + old[2]) - max(b[0], old[0])) * max(0, min(b[1] + b[3], old[1] + old[3]) - max(b[1], old[1]))
                share, far = common / min(b[2] * b[3], old[2] * old[3]), math.dist((b[0] + b[2] / 2, b[1] + b[3] / 2), (old[0] + old[2] / 2, old[1] + old[3] / 2))
                same = bool(ids & names)
                if flags[1] or before[1] or flags[0] != before[0] or flags[2] != before[2] or not (0.4 <= b[2] / old[2] <= 2.5 and 0.45 <= b[3] / old[3] <= 2.2):
                    continue
                if share >= 0.2 or (same and far < max(100, 2 * old[3])):
                    pairs.append((share + 0.25 * same - far / 5000, i, track))
        got = {}
        while pairs:
            best = max(pairs)
            got[best[1]] = best[2]
            pairs = [p for p in pairs if p[1] != best[1] and p[2] != best[2]]
        now = []
        for i, row in enumerate(rows):
            if i not in got:
                got[i], n = n, n + 1
            now.append((at, got[i], *row))
        out.append([x[1] for x in now])
        live = now
    return out


def test_association_equals_brute_force():
    rng = random.Random(3)
    for _ in range(60):
        frames, at = [], 0
        for _ in range(12):
            at += rng.choice([1, 1, 1, 2])
            rows = [((rng.randrange(0, 160, 8), rng.randrange(0, 60, 6), rng.randrange(10, 60, 5), rng.randrange(8, 30, 3)), frozenset(rng.sample(["a", "b", "c"], rng.randint(0, 2))), rng.random() < 0.2, rng.random() < 0.1, rng.random() < 0.2) for _ in range(rng.randint(1, 6))]
            frames.append((at, rows))
        state = tracking.Tracks()
        got = [state.step(at, np.array([r[0] for r in rows]), [r[1] for r in rows], *(np.array([r[k] for r in rows]) for k in (2, 3, 4))).tolist() for at, rows in frames]
        assert got == brute_tracks(frames)


def test_stable_boxes_keep_the_rules(spark):
    rows = [(1, 0, f, 0, "a", 100 + f % 3, 50, 40, 20, "domain", False) for f in range(9)] + [(1, 0, f, 1, "b", 300, 50, 40, 20, "reviewed_word", False) for f in range(9)]
    rows += [(1, 0, f, 2, "c", 500 + f % 2, 50, 40, 20, "reviewed_path", None) for f in range(9)] + [(2, 0, f, 0, None, 10, 10, 0 + 9, 9, None, None) for f in (0, 1, 3)]
    df = spark.createDataFrame(rows, "source_id bigint, segment bigint, frame bigint, ord bigint, region_id string, x bigint, y bigint, w bigint, h bigint, kind string, fixed boolean")
    out = {(r.source_id, r.frame, r.ord): r for r in tracking.stabilise(df, 640, 360).collect()}
    assert len(out) == 30
    assert {(r.sx, r.sw, r["mode"], r.paint_order) for k, r in out.items() if k[0] == 1 and k[2] == 0} == {(100, 42, "static", 0)}
    assert {r.paint_order for k, r in out.items() if k[2] == 1} == {1}
    assert all((r.sx, r.sw) == (r.x, r.w) for k, r in out.items() if k[2] == 2)  # bounds stay, and no track goes on
    assert len({r.track for k, r in out.items() if k[0] == 1 and k[2] == 2}) == 9 and len({r.track for k, r in out.items() if k[0] == 2}) == 2
    stats = {r.source_id: r for r in tracking.statistics(tracking.stabilise(df, 640, 360)).collect()}
    assert (stats[1].tracks, stats[1].static_runs, stats[1].source_regions, stats[2].moving_runs) == (11, 2, 27, 2)


def test_backfill_rules(spark):
    rows = [(1, f, f in (3, 9), True, f == 6) for f in range(12)]
    out = backfill_batch(spark.createDataFrame(rows, "source_id bigint, frame bigint, detected boolean, match boolean, cut boolean"), 1, 2)
    assert [r.origin for r in out.orderBy("frame").collect()] == ["none", "backfilled", "backfilled", "ocr", "tracked", "none", "none", "backfilled", "backfilled", "ocr", "tracked", "none"]
