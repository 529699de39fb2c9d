"""Reports of a first pass as tables, with the checks that they are complete."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

_BOX = "array<bigint>"
REPORT = (
    f"status string, width bigint, height bigint, fps double, processed_frames bigint, scene_cuts array<bigint>, "
    f"frames array<struct<frame:bigint,time:double,boxes:array<{_BOX}>,origins:array<string>,"
    "regions:array<struct<id:string,kind:string,origin:string,box_method:string,ocr_confidence:double,tracking_score:double,relative_scale:double>>>>"
)


def read_reports(spark: SparkSession, path: str) -> DataFrame:
    """One row for each report file, with its path as source_id and the SHA-256 of its bytes."""
    files = spark.read.format("binaryFile").load(path)
    rows = files.select(F.col("path").alias("source_id"), F.sha2("content", 256).alias("sha256"), F.from_json(F.col("content").cast("string"), REPORT).alias("r"))
    return rows.select("source_id", "sha256", "r.*")


def regions(reports: DataFrame) -> DataFrame:
    """The parallel arrays of each frame as rows."""
    frames = reports.select("source_id", F.explode("frames").alias("f"))
    each = frames.select("source_id", "f.frame", F.posexplode(F.arrays_zip("f.boxes", "f.origins", "f.regions")).alias("ord", "z"))
    boxes = [F.element_at("z.boxes", i + 1).alias(c) for i, c in enumerate("xywh")]
    return each.select("source_id", "frame", F.col("ord").cast("bigint"), *boxes, F.col("z.origins").alias("origin"), F.col("z.regions.id").alias("region_id"), "z.regions.kind", "z.regions.box_method", F.col("z.regions.ocr_confidence").alias("confidence"))


def faults(reports: DataFrame) -> DataFrame:
    """source_id and fault: what a complete report must not show."""
    f = F.col("frames")
    dense = F.forall(F.sequence(F.lit(1), F.greatest(F.size(f), F.lit(1))), lambda i: F.get(f, i - 1)["frame"] == (i - 1))
    aligned = F.forall(f, lambda x: (F.size(x["boxes"]) == F.size(x["regions"])) & (F.size(x["boxes"]) == F.size(x["origins"])))
    inside = F.forall(f, lambda x: F.forall(x["boxes"], lambda b: (F.size(b) == 4) & (b[0] >= 0) & (b[1] >= 0) & (b[2] > 0) & (b[3] > 0) & (b[0] + b[2] <= F.col("width")) & (b[1] + b[3] <= F.col("height"))))
    rules = {
        "not_complete": F.col("status") == "complete", "bad_size": (F.col("width") > 0) & (F.col("height") > 0), "bad_rate": F.col("fps").between(1, 120),
        "frame_count": (F.size(f) > 0) & (F.size(f) == F.col("processed_frames")), "frame_index": dense, "region_arrays": aligned, "box_outside": inside,
    }
    names = F.array_compact(F.array(*[F.when(~F.coalesce(ok, F.lit(False)), name) for name, ok in rules.items()]))
    return reports.select("source_id", F.explode(names).alias("fault"))


def chunk_faults(parts: DataFrame, group: str) -> DataFrame:
    """Parts (name, start_frame, frames) whose start is not the number of frames before them."""
    before = F.coalesce(F.sum("frames").over(Window.partitionBy(group).orderBy("start_frame", "name").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return parts.withColumn("expected_start", before.cast("bigint")).where("start_frame <> expected_start")


def file_catalog(spark: SparkSession, path: str) -> DataFrame:
    """path, bytes and sha256 of the files below a folder."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return files.select("path", F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"))


def media_rates(media: DataFrame) -> DataFrame:
    """The first video stream that is no attached picture, its rate as a fraction, and how constant it is by its metadata."""
    video = F.filter("streams", lambda s: (s["codec_type"] == "video") & (F.coalesce(s["disposition"]["attached_pic"], F.lit(0)) == 0))
    out = media.withColumn("v", F.get(video, F.lit(0)))

    def rate(name: str, part: int):
        return F.regexp_extract(F.col(f"v.{name}"), r"^(\d+)/(\d+)$", part).cast("bigint")

    ok = {n: (rate(n, 1) > 0) & (rate(n, 2) > 0) for n in ("avg_frame_rate", "r_frame_rate")}
    num, den = (F.when(ok["avg_frame_rate"], rate("avg_frame_rate", i)).when(ok["r_frame_rate"], rate("r_frame_rate", i)) for i in (1, 2))
    both = ok["avg_frame_rate"] & ok["r_frame_rate"]
    differ = rate("avg_frame_rate", 1) * rate("r_frame_rate", 2) != rate("r_frame_rate", 1) * rate("avg_frame_rate", 2)
    hint = F.when(both & differ, "variable_or_mixed").when(both, "constant_rate_metadata_unverified").otherwise("unknown")
    return out.withColumns({"rate_num": num, "rate_den": den, "rate_hint": hint}).drop("v")
