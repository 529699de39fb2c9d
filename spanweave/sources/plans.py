"""Reviewed plans: contract checks on the driver, then tables. A plan is a small document; its frames are not listed here."""

from __future__ import annotations

import hashlib
import json
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

from ..operators.pixels import Fill, polygon_mask

PLAN_BYTES, ASSET_BYTES = 64 << 20, 256 << 20
REGION = "region_id string, start bigint, end bigint, frame bigint, x bigint, y bigint, w bigint, h bigint, polygon array<array<bigint>>, segment string, mode string"


class PlanError(ValueError):
    pass


def _need(ok: bool, what: str) -> None:
    if not ok:
        raise PlanError(what)


def _whole(value: object) -> bool:
    return type(value) is int


def _geometry(g: object, width: int, height: int) -> tuple[list[int] | None, list[list[int]] | None]:
    _need(isinstance(g, dict) and set(g) in ({"box"}, {"polygon"}), "geometry must be one box or one polygon")
    if "box" in g:
        b = g["box"]
        _need(isinstance(b, list) and len(b) == 4 and all(map(_whole, b)), "box must be four whole numbers")
        _need(0 <= b[0] < b[0] + b[2] <= width and 0 <= b[1] < b[1] + b[3] <= height, "box outside frame")
        return b, None
    p = g["polygon"]
    _need(isinstance(p, list) and all(isinstance(q, list) and len(q) == 2 and all(map(_whole, q)) for q in p), "polygon must be points of whole numbers")
    polygon_mask([tuple(q) for q in p], width, height)
    return None, p


def bound_asset(folder: Path, name: str, sha256: str, budget: int = ASSET_BYTES) -> bytes:
    """A file of the plan's own folder whose hash is as the plan says."""
    path = (folder / name).resolve()
    _need(not Path(name).is_absolute() and path.is_relative_to(folder.resolve()), "asset outside the plan's folder")
    _need(path.is_file() and path.stat().st_size <= budget, "asset missing or too large")
    data = path.read_bytes()
    _need(hashlib.sha256(data).hexdigest() == sha256, "asset hash differs")
    return data


def read_plan(path: str, source_sha256: str, width: int, height: int) -> dict:
    """A checked plan: approved, without open gaps, bound to its source, its regions unique and complete."""
    file = Path(path)
    _need(file.stat().st_size <= PLAN_BYTES, "plan too large")
    plan = json.loads(file.read_bytes())
    _need(plan.get("version") == 1 and plan.get("source_sha256") == source_sha256, "plan is for another version or source")
    _need(plan.get("review_status") == "approved" and not plan.get("pending_gaps"), "plan is not approved or has open gaps")
    a, b = plan.get("start_frame"), plan.get("end_frame")
    _need(_whole(a) and _whole(b) and 0 <= a < b, "bad frame window")
    _need(all(_whole(c) and a <= c < b for c in plan.get("scene_cuts", [])), "scene cut outside the window")
    rows, names = [], set()
    for region in plan.get("regions", []):
        name, start, end = region.get("id"), region.get("start_frame"), region.get("end_frame")
        _need(isinstance(name, str) and name != "" and name not in names, "region ids must be unique")
        names.add(name)
        _need(_whole(start) and _whole(end) and a <= start < end <= b, "region outside the window")
        _need(("geometry" in region) != ("geometry_by_frame" in region), "a region has one kind of geometry")
        fill = region.get("fill", {})
        mode = Fill(**{("color" if k == "color_bgr" else k): tuple(v) if isinstance(v, list) else v for k, v in fill.items()}).mode
        by_frame = region.get("geometry_by_frame")
        if by_frame is None:
            shapes = [(None, region["geometry"])]
        else:
            _need(set(by_frame) == {str(f) for f in range(start, end)}, "tracked geometry must cover every frame and no other")
            shapes = [(int(f), g) for f, g in sorted(by_frame.items(), key=lambda x: int(x[0]))]
        for frame, shape in shapes:
            box, polygon = _geometry(shape, width, height)
            rows.append((name, start, end, frame, *(box or [None] * 4), polygon, region.get("surface_segment", "default"), mode))
    for o in plan.get("overlays", []):
        _need(all(_whole(o.get(k)) for k in ("x", "y", "start_frame", "end_frame")) and a <= o["start_frame"] < o["end_frame"] <= b, "overlay outside the window")
        bound_asset(file.parent, o.get("path", ""), o.get("sha256", ""))
    return {"start": a, "end": b, "scene_cuts": plan.get("scene_cuts", []), "regions": rows, "overlays": plan.get("overlays", []), "sha256": hashlib.sha256(file.read_bytes()).hexdigest()}


def plan_regions(spark: SparkSession, plan: dict) -> DataFrame:
    return spark.createDataFrame(plan["regions"], REGION)


def active(regions: DataFrame) -> DataFrame:
    """One row for each region and frame that it is active in, so frames join by equality."""
    from pyspark.sql import functions as F

    fixed = regions.where("frame IS NULL").withColumn("frame", F.explode(F.sequence(F.col("start"), F.col("end") - 1)))
    return fixed.unionByName(regions.where("frame IS NOT NULL"))
