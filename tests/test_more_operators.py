"""Alignment, pixels, adapters, plans and sinks on small inputs."""

import hashlib
import json
import sys

import numpy as np
import pytest
from pyspark.sql import functions as F

from spanweave.functions import boxes
from spanweave.operators import alignment, pixels
from spanweave.sources import adapters, plans, sinks

BOX = "struct<x:double,y:double,w:double,h:double>"


def glyphs(text, w=0.8):
    return [{"start": i, "end": i + 1, "box": {"x": 0.1 + w * i / len(text), "y": 0.4, "w": w / len(text), "h": 0.1}} for i in range(len(text))]


def observation(idx, text, engine=None, chars=None, confidence=0.9, box=(0.1, 0.4, 0.8, 0.1)):
    return (1, 7, idx, text, confidence, dict(zip("xywh", box, strict=True)), glyphs(text) if chars is None else chars, engine)


def aligned(spark, rows):
    out = alignment.independent_geometry(spark.createDataFrame(rows, alignment.OBSERVATION)).orderBy("obs_idx").collect()
    return [(r.geometry_engine, r.geometry_only, len(r.chars)) for r in out]


def test_fast_glyphs_serve_an_accurate_line(spark):
    whole = [{"start": i, "end": i + 1, "box": {"x": 0.1, "y": 0.4, "w": 0.8, "h": 0.1}} for i in range(13)]
    assert aligned(spark, [observation(0, "www.shop.com/", chars=whole), observation(1, "www.shap.com/", "vision_fast")]) == [("vision_fast_aligned", False, 13), ("vision_fast", True, 13)]
    assert aligned(spark, [observation(0, "www.shop.com/", chars=whole), observation(1, "www.5h0p.com/", "vision_fast")])[0][0] is None
    assert aligned(spark, [observation(0, "www.shop.com/"), observation(1, "www.shop.com/", "vision_fast")])[0][0] is None
    assert aligned(spark, [observation(0, "www.shop.com/", chars=whole), observation(1, "www.shop.com/", "vision_fast", confidence=0.4)])[0][0] is None


def test_split_addresses(spark):
    rows = [observation(0, "see www.", box=(0.1, 0.4, 0.2, 0.05)), observation(1, "shop.com", box=(0.31, 0.4, 0.2, 0.05)), observation(2, "far.com", box=(0.9, 0.9, 0.05, 0.05))]
    out = alignment.split_addresses(spark.createDataFrame(rows, alignment.OBSERVATION)).collect()
    assert [(r.obs_idx, r.other, r.status) for r in out] == [(0, 1, "needs_review")]


def test_codes(spark):
    rows = spark.createDataFrame([(1, 0, (0.1, 0.2, 0.3, 0.4), None)], f"source_id bigint, frame bigint, box {BOX}, confidence double")
    assert tuple(alignment.code_findings(rows, 100, 100).first().pixel_box) == (6, 16, 38, 48)


def test_distinct_boxes(spark):
    df = spark.createDataFrame([([(0, 0, 10, 10), (0, 0, 10, 9), (50, 50, 5, 5)],)], f"b array<{boxes.BOX}>")
    assert len(df.select(alignment.distinct_boxes(F.col("b"), 0.8)).first()[0]) == 2


def test_anchors_and_events(spark):
    rows = [(1, f, f in (2, 8), f != 5, f == 10) for f in range(12)]
    out = alignment.anchor_reach(spark.createDataFrame(rows, "source_id bigint, frame bigint, is_anchor boolean, follows boolean, cut boolean"))
    assert {r.frame: r.anchor for r in out.collect()} == {0: 2, 1: 2, 2: 2, 3: 2, 4: 2, 5: 8, 6: 8, 7: 8, 8: 8, 9: 8}
    near = alignment.nearest_anchor(spark.createDataFrame([(1, 5, 2), (1, 5, 8), (1, 6, 8)], "source_id bigint, frame bigint, anchor bigint"))
    assert sorted((r.frame, r.anchor) for r in near.collect()) == [(5, 2), (6, 8)]
    regions = [(1, f, 0, "a", 10 + f, 10, 20, 20) for f in range(4)] + [(1, 2, 1, "a", 900, 900, 20, 20), (1, 6, 0, "a", 10, 10, 20, 20)]
    df = spark.createDataFrame(regions, "source_id bigint, frame bigint, ord bigint, region_id string, x bigint, y bigint, w bigint, h bigint")
    linked = {(r.frame, r.ord): r.event_id for r in alignment.link_events(df, spark.createDataFrame([(1, 3)], "source_id bigint, frame bigint")).collect()}
    assert linked[0, 0] == linked[1, 0] == linked[2, 0] and len({linked[2, 0], linked[2, 1], linked[3, 0], linked[6, 0]}) == 4


def flat(value, height=60, width=80):
    return np.full((height, width, 3), value, np.uint8)


def test_smoothing_resets():
    fill, filler = pixels.Fill(smooth_alpha=0.25), pixels.Filler()
    mask = pixels.box_mask((30, 20, 20, 10), 80, 60)
    seen = [int(filler.apply(flat(v), n, [("r", seg, mask, fill)], cut=cut)[25, 40, 0]) for v, n, seg, cut in ((20, 0, "s", False), (40, 1, "s", False), (50, 2, "s", True), (60, 4, "s", False), (70, 5, "t", False))]
    assert seen == [20, 25, 50, 60, 70]


def test_masks_and_fills():
    bitmap = np.full((10, 20), 255, np.uint8)
    bitmap[3:7, 8:12] = 0
    assert pixels.bitmap_mask(bitmap, (5, 5, 20, 10), 80, 60).sum() == 184
    assert pixels.polygon_mask([(10, 10), (20, 10), (20, 20), (10, 20)], 80, 60).sum() == 121
    for bad in ([(0, 0), (1, 1)], [(0, 0), (10, 0), (2, 2), (0, 10)], [(0, 0), (90, 0), (5, 5)], [(0, 0), (2, 2), (4, 4)]):
        with pytest.raises(ValueError, match="polygon"):
            pixels.polygon_mask(bad, 80, 60)
    slope = np.zeros((60, 80, 3), np.uint8)
    slope[:] = (100 + np.arange(80) // 4)[None, :, None]
    mask = pixels.box_mask((30, 20, 20, 10), 80, 60)
    broken = slope.copy()
    broken[mask] = 255
    out = pixels.Filler().apply(broken, 0, [("r", "s", mask, pixels.Fill(mode="plane"))])
    assert np.abs(out.astype(int) - slope)[mask].max() <= 2 and pixels.changed_outside(broken, out, mask) == 0
    noise = np.random.default_rng(1).integers(0, 255, (60, 80, 3), dtype=np.uint8)
    with pytest.raises(pixels.SamplingError):
        pixels.Filler().apply(noise, 0, [("r", "s", mask, pixels.Fill())])
    with pytest.raises(ValueError, match="range"):
        pixels.Fill(smooth_alpha=0)


def test_sampling_does_not_see_overlays():
    frame = flat(100)
    frame[10:40, 20:60] = 10  # under an overlay's canvas
    mask, canvas = pixels.box_mask((30, 20, 20, 10), 80, 60), pixels.box_mask((20, 10, 40, 30), 80, 60)
    assert pixels.Filler().apply(frame, 0, [("r", "s", mask, pixels.Fill(radius=40))], [canvas])[25, 40, 0] == 100
    picture = np.zeros((4, 4, 4), np.uint8)
    picture[..., 0], picture[:2, :, 3] = 200, 255
    out = pixels.overlay(frame, picture, 0, 0)
    assert out[0, 0, 0] == 200 and out[3, 0, 0] == 100


def test_frames_as_tables(spark):
    rows = [(1, 0, f, 80, 60, flat(50 + f).tobytes(), [(30, 20, 20, 10)], False) for f in range(3)]
    df = spark.createDataFrame(rows, f"source_id bigint, segment bigint, frame bigint, width int, height int, pixels binary, boxes array<{boxes.BOX}>, cut boolean")
    covered = pixels.cover_frames(df).orderBy("frame").first()
    assert np.frombuffer(covered.pixels, np.uint8).reshape(60, 80, 3)[25, 35, 0] == pixels.GREY
    assert not any(r.fell_back for r in pixels.fill_frames(df).collect())


ECHO = """
import json, sys
for line in sys.stdin:
    m = json.loads(line)
    if m["do"] == "die": sys.exit(1)
    if m["do"] == "sleep":
        import time; time.sleep(60)
    print(json.dumps(m["say"]), flush=True)
"""


def test_worker_fails_alone():
    good = {"observations": [], "more": 1}
    worker = adapters.LineWorker([sys.executable, "-c", ECHO], timeout=20)
    assert worker.request({"do": "say", "say": good}) == good
    worker.timeout = 0.3
    with pytest.raises(adapters.WorkerFailed, match="timeout"):
        worker.request({"do": "sleep"})
    with pytest.raises(adapters.WorkerFailed, match="timeout"):
        worker.request({"do": "say", "say": good})
    with pytest.raises(ValueError, match="positive"):
        adapters.LineWorker(["true"], timeout=float("nan"))


@pytest.mark.parametrize(
    ("value", "good"),
    [
        ({"observations": []}, True), ({"observations": [{"text": "a", "box": [0, 0, 1, 1], "more": 1, "chars": [{"start": 0, "end": 1, "box": [0, 0, 0, 0]}]}], "codes": []}, True),
        ([], False), ({}, False), ({"observations": None}, False), ({"observations": [{"text": 1, "box": [0, 0, 1, 1]}]}, False), ({"observations": [{"text": "a", "box": [0, 0, 0, 1]}]}, False),
        ({"observations": [{"text": "a", "box": [0, 0, float("nan"), 1]}]}, False), ({"observations": [{"text": "a", "box": [0, 0, 1, True]}]}, False),
        ({"observations": [{"text": "a", "box": [0, 0, 1, 1], "chars": {}}]}, False), ({"observations": [{"text": "a", "box": [0, 0, 1, 1], "chars": [{"start": 0.0, "end": 1, "box": [0, 0, 1, 1]}]}]}, False),
        ({"observations": [], "codes": {}}, False), ({"observations": [], "barcodes": [{"box": [0, 0, 0, 1]}]}, False), ({"observations": [{"text": "a", "box": [0, 0, 1, 1], "confidence": "x"}]}, False),
    ],
)
def test_answers_are_checked(value, good):
    assert adapters.valid_response(value) is good


def test_failures_are_rows(spark):
    requests = [{"do": "say", "say": {"observations": []}}, {"do": "say", "say": {"observations": 1}}, {"do": "die"}, {"do": "say", "say": {"observations": []}}]
    df = spark.createDataFrame([(1, i, json.dumps(r)) for i, r in enumerate(requests)], "source_id bigint, frame bigint, request string").coalesce(1)
    out = adapters.recognise(df, lambda: adapters.LineWorker([sys.executable, "-c", ECHO], timeout=20)).orderBy("frame").collect()
    assert [r.failure for r in out] == [None, "invalid_response", "worker_ended", "worker_ended"]


def plan(**change):
    base = {"version": 1, "source_sha256": "s", "review_status": "approved", "pending_gaps": [], "start_frame": 0, "end_frame": 10, "scene_cuts": [4], "overlays": [], "regions": [
        {"id": "a", "start_frame": 1, "end_frame": 3, "geometry": {"box": [1, 2, 3, 4]}}, {"id": "b", "start_frame": 2, "end_frame": 4, "geometry_by_frame": {"2": {"polygon": [[0, 0], [9, 0], [9, 9]]}, "3": {"box": [0, 0, 5, 5]}}}]}
    return base | change


def test_plans(spark, tmp_path):
    def read(**change):
        (tmp_path / "plan.json").write_text(json.dumps(plan(**change)))
        return plans.read_plan(str(tmp_path / "plan.json"), "s", 20, 20)

    rows = plans.active(plans.plan_regions(spark, read()))
    assert sorted((r.region_id, r.frame) for r in rows.collect()) == [("a", 1), ("a", 2), ("b", 2), ("b", 3)]
    twice = [plan()["regions"][0]] * 2
    short = [dict(plan()["regions"][1], geometry_by_frame={"2": {"box": [0, 0, 5, 5]}})]
    out = [dict(plan()["regions"][0], geometry={"box": [18, 0, 5, 5]})]
    for bad in ({"version": 2}, {"source_sha256": "t"}, {"review_status": "draft"}, {"pending_gaps": [1]}, {"scene_cuts": [10]}, {"regions": twice}, {"regions": short}, {"regions": out}):
        with pytest.raises(plans.PlanError):
            read(**bad)
    (tmp_path / "a.png").write_bytes(b"x")
    assert plans.bound_asset(tmp_path, "a.png", hashlib.sha256(b"x").hexdigest()) == b"x"
    for name, sha in (("../a.png", ""), ("/etc/hosts", ""), ("a.png", "0" * 64)):
        with pytest.raises(plans.PlanError):
            plans.bound_asset(tmp_path, name, sha)


def test_sinks(spark, tmp_path):
    rows = spark.createDataFrame([(1, 10, 25, 10, 25), (2, 60, 62, 66, 68)], "ordinal int, start bigint, end bigint, source_start bigint, source_end bigint")
    sinks.write_timeline(rows, f"{tmp_path}/t", 10)
    assert [r.value for r in spark.read.text(f"{tmp_path}/t/markdown").collect()] == ["| 1 | 00:01.000–00:02.500 | 00:01.000–00:02.500 |", "| 2 | 00:06.000–00:06.200 | 00:06.600–00:06.800 |"]
    assert spark.read.option("header", True).csv(f"{tmp_path}/t/csv").columns == sinks.TIMELINE
    with pytest.raises(Exception, match="ALREADY_EXISTS"):
        sinks.write_table(rows, f"{tmp_path}/t/csv")
    with pytest.raises(RuntimeError), sinks.report(spark, f"{tmp_path}/r", {"source": "x"}):
        raise RuntimeError("secret text")
    said = spark.read.text(f"{tmp_path}/r/report").first()[0]
    assert '"failed"' in said and "secret" not in said
    files = spark.createDataFrame([("a", 1, "x"), ("b", 2, "y")], "path string, bytes bigint, sha256 string")
    assert sinks.catalog_faults(files, files.where("path = 'a'")).count() == 1 and tuple(sinks.catalog_totals(files).first()) == (2, 3)
