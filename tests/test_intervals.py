"""Golden values of the interval algebra."""

from pyspark.sql import functions as F

from spanweave.operators import intervals as op


def got(df, *columns):
    return sorted(tuple(r) for r in df.select(*columns).collect())


def test_runs_of_flags(spark):
    flags = [True, False, True, True, False, True]
    df = spark.createDataFrame([(1, i, f) for i, f in enumerate(flags)], "k int, frame bigint, flag boolean")
    assert got(op.runs(df, F.col("flag"), ["k"]), "start", "end") == [(0, 1), (2, 4), (5, 6)]


def test_gap_merge_and_catalog(spark):
    runs = spark.createDataFrame([(1, 0, 2), (1, 32, 34), (1, 65, 66)], "k int, start bigint, end bigint")
    merged = op.merge_gaps(runs, ["k"], 30)
    assert got(merged, "start", "end") == [(0, 34), (65, 66)]
    assert got(op.catalog(merged, runs, "k"), "segment", "collection_start", "masked_frames", "context_frames") == [(1, 0, 4, 30), (2, 34, 1, 0)]


TIMELINE = [(1, 1, 10, 20), (1, 2, 18, 25), (1, 3, 26, 27), (1, 4, 59, 62)]


def timeline(spark, events, cuts):
    e = spark.createDataFrame(events, "k int, event_id int, start bigint, end bigint")
    c = spark.createDataFrame([(1, a, b) for a, b in cuts], "k int, a bigint, b bigint")
    return op.merge_at_cuts(e, c, "k")


def test_merge_stops_at_cuts(spark):
    out = timeline(spark, TIMELINE, [(60, 66)])
    assert got(out, "start", "end") == [(10, 25), (26, 27), (59, 60), (60, 62)]
    assert got(out.where("start >= 59"), "source_start", "source_end") == [(59, 60), (66, 68)]


def test_cuts_at_both_ends(spark):
    out = timeline(spark, [(1, 1, 0, 20)], [(0, 2), (7, 10), (17, 20), (28, 31)])
    assert got(out, "start", "end", "source_start", "source_end") == [(0, 5, 2, 7), (5, 12, 10, 17), (12, 20, 20, 28)]


def test_mapping_and_its_inverse(spark):
    cuts = spark.createDataFrame([(1, 60, 66)], "k int, a bigint, b bigint")
    out = op.with_cuts(spark.createDataFrame([(1, f) for f in (59, 60, 61, 119)], "k int, f bigint"), cuts, "k")
    assert got(out, op.to_source(F.col("f"), F.col("cuts"))) == [(59,), (66,), (67,), (125,)]
    back = op.with_cuts(spark.createDataFrame([(1, f) for f in (59, 60, 65, 66)], "k int, f bigint"), cuts, "k")
    assert [r[0] for r in back.orderBy("f").select(op.to_output(F.col("f"), F.col("cuts"))).collect()] == [59, None, None, 60]


def test_filter_before_merging(spark):
    out = timeline(spark, [TIMELINE[0], *TIMELINE[2:]], [(60, 66)])
    assert got(out, "start", "end") == [(10, 20), (26, 27), (59, 60), (60, 62)]


def test_empty_input(spark):
    none = spark.createDataFrame([], "k int, start bigint, end bigint")
    assert op.merge_gaps(none, ["k"], 0).count() == 0
    assert timeline(spark, [(1, 1, 0, 5)], []).count() == 1


def test_of_equal_intervals_the_least_event_is_good(spark):
    rows = [(1, 1, 0, 5), (1, 2, 10, 20), (1, 3, 10, 20), (1, 4, 10, 20), (1, 5, 30, 31)]
    for order in (rows, rows[::-1], rows[2:] + rows[:2]):
        df = spark.createDataFrame(order, "k int, event_id int, start bigint, end bigint").coalesce(1)
        assert got(op.bad_intervals(df, ["k"]), "event_id") == [(3,), (4,)]
