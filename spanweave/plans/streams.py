"""Queries that run a stream to its end over a table and hold it against batch."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..runtime import scratch_dir
from ..sources import derived
from ..streaming.backfill import backfill_batch, backfill_stream

PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def _marked(rows):
    e = F.col("event_id")
    return rows.select("source_id", "frame", (e % 6 == 0).alias("detected"), (e % 5 != 0).alias("match"), (e % 17 == 0).alias("cut"), "last")


def _frames(spark, d):
    f = derived.frames(spark, d)
    ends = f.groupBy("source_id").agg(F.max("frame").alias("end"))
    return _marked(f.join(ends, "source_id").withColumn("last", F.col("frame") == F.col("end")))


def frame_backfill(spark, d):
    return backfill_batch(_frames(spark, d), 3, 4)


def stream_backfill_equals_batch(spark, d):
    """Frames on which the stream and the batch form differ, with both origins: none."""
    folder = scratch_dir(spark)
    frames = _frames(spark, d)
    # The feed arrives in files, by stretches of frames; their names keep the order.
    frames.withColumn("stretch", F.floor(F.col("frame") / 40)).repartition("stretch").write.partitionBy("stretch").parquet(f"{folder}/feed")
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name)
    spark.conf.set(name, PROVIDER)
    try:
        feed = spark.readStream.schema(frames.schema).parquet(f"{folder}/feed")
        given = backfill_stream(feed, 3, 4)
        query = given.writeStream.format("parquet").option("path", f"{folder}/given").option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start()
        query.awaitTermination()
    finally:
        spark.conf.set(name, before)
    stream = spark.read.schema("source_id bigint, frame bigint, origin string").parquet(f"{folder}/given").withColumnRenamed("origin", "streamed")
    both = backfill_batch(frames, 3, 4).join(stream, ["source_id", "frame"], "full")
    return both.where(~F.col("origin").eqNullSafe(F.col("streamed")))


QUERIES = {f.__name__: f for f in (frame_backfill, stream_backfill_equals_batch)}

ORACLES = {
    "frame_backfill": """WITH f AS (SELECT user_id AS source_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS frame FROM events),
c AS (SELECT source_id, frame, event_id % 6 = 0 AS hit, sum(CASE WHEN event_id % 5 = 0 OR event_id % 17 = 0 OR frame = 0 THEN 1 ELSE 0 END) OVER (PARTITION BY source_id ORDER BY frame) AS chain FROM f)
SELECT a.source_id, a.frame, CASE WHEN any_value(a.hit) THEN 'ocr' WHEN count(b.frame) FILTER (b.frame < a.frame AND a.frame - b.frame <= 3) > 0 THEN 'tracked'
  WHEN count(b.frame) FILTER (b.frame > a.frame AND b.frame - a.frame <= 4) > 0 THEN 'backfilled' ELSE 'none' END AS origin
FROM c a LEFT JOIN c b ON a.source_id = b.source_id AND a.chain = b.chain AND b.hit GROUP BY a.source_id, a.frame""",
    "stream_backfill_equals_batch": "SELECT CAST(NULL AS BIGINT) AS source_id, CAST(NULL AS BIGINT) AS frame, CAST(NULL AS VARCHAR) AS origin, CAST(NULL AS VARCHAR) AS streamed WHERE false",
}
