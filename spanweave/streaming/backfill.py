"""Bounded look-back over a live frame feed, as a stateful stream and as the same thing in batch.

A frame has detected (a box was found), match (what was there looks the same as in the frame before) and cut (a new
scene starts). A frame without a detection is tracked, if matches lead back to one at most max_gap frames before, or
else backfilled, if matches lead on to one at most hold frames later. Both stop at cuts and missing frames.

The stream holds back the last ``hold`` frames of each source, so a later detection can still reach them; a frame that
was given out is never changed. State is a source's held frames, so it is bounded by hold.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

COLUMNS = ["frame", "detected", "match", "cut"]
STATE = "frame bigint, detected boolean, chained boolean, reached boolean, age bigint, near boolean"
OUTPUT = "source_id bigint, frame bigint, origin string"


def backfill_batch(frames: DataFrame, max_gap: int, hold: int) -> DataFrame:
    """source_id, frame, origin (ocr, tracked, backfilled or none) with windows alone."""
    w = Window.partitionBy("source_id").orderBy("frame")
    breaks = F.col("cut") | ~F.col("match") | F.lag("frame").over(w).isNull() | (F.col("frame") != F.lag("frame").over(w) + 1)
    chain = frames.withColumn("b", breaks.cast("int")).withColumn("chain", F.sum("b").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    c = Window.partitionBy("source_id", "chain").orderBy("frame")
    hit = F.when(F.col("detected"), F.col("frame"))
    before, after = F.max(hit).over(c.rowsBetween(Window.unboundedPreceding, 0)), F.min(hit).over(c.rowsBetween(0, Window.unboundedFollowing))
    origin = F.when(F.col("detected"), "ocr").when(F.col("frame") - before <= max_gap, "tracked").when(after - F.col("frame") <= hold, "backfilled").otherwise("none")
    return chain.select("source_id", "frame", origin.alias("origin"))


class _Feed(StatefulProcessor):
    """One source: frames in order; the last ones are held."""

    def __init__(self, max_gap: int, hold: int) -> None:
        self.max_gap, self.hold = max_gap, hold

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.held = handle.getListState("held", STATE)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        # Held: frame, detected, chained to the one before, reached from later, age since a detection (-1: none), near.
        held = [list(r) for r in self.held.get()] if self.held.exists() else []
        fresh = pd.concat(list(rows)).sort_values("frame")
        out = []
        for frame, detected, match, cut in fresh[COLUMNS].itertuples(index=False):
            chained = bool(match) and not cut and bool(held) and held[-1][0] + 1 == frame
            age = 0 if detected else held[-1][4] + 1 if chained and held[-1][4] >= 0 else -1
            held.append([int(frame), bool(detected), chained, False, int(age), bool(detected) or 0 <= age <= self.max_gap])
            if detected:
                for k in range(len(held) - 1, 0, -1):
                    before = held[k - 1]
                    if not held[k][2] or frame - before[0] > self.hold:
                        break
                    before[3] = True
            while len(held) > self.hold + 1:
                out.append(self._give(held.pop(0)))
        last = bool(fresh["last"].any())
        while last and held:
            out.append(self._give(held.pop(0)))
        if held:
            self.held.put([tuple(h) for h in held])
        else:
            self.held.clear()
        yield pd.DataFrame([(key[0], *o) for o in out], columns=["source_id", "frame", "origin"])

    def _give(self, h: list) -> tuple[int, str]:
        frame, detected, _, reached, _, near = h
        return frame, "ocr" if detected else "tracked" if near else "backfilled" if reached else "none"

    def close(self) -> None:
        pass


def backfill_stream(frames: DataFrame, max_gap: int, hold: int) -> DataFrame:
    """The same from a stream of frames with one more column, last, that marks a source's end.

    Needs the RocksDB state store: spark.sql.streaming.stateStore.providerClass. Frames of a source must not come before
    earlier ones were given; within a batch they are sorted.
    """
    # Spark starts this processor on the driver too, in a process that has no access to sent files.
    cloudpickle.register_pickle_by_value(sys.modules[__name__])
    return frames.groupBy("source_id").transformWithStateInPandas(_Feed(max_gap, hold), outputStructType=OUTPUT, outputMode="append", timeMode="none")
