"""Every query of the library's own operators against DuckDB, and those without SQL for what must hold."""

import pytest
from oracle import assert_same

from pyspark.sql import functions as F

from spanweave.operators import tracking
from spanweave.plans import catalog


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_query_equals_its_oracle(spark, duck, sf_dir, name):
    assert_same(catalog.QUERIES[name](spark, sf_dir), duck, catalog.ORACLES[name])


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.ORACLES)))
def test_query_without_sql_has_rows(spark, sf_dir, name):
    assert catalog.QUERIES[name](spark, sf_dir).count() > 0


def test_faults_are_found(spark, sf_dir, monkeypatch):
    """The checks of the greedy queries see an association that is not greedy."""
    real = tracking.stabilise
    monkeypatch.setattr(tracking, "stabilise", lambda *a: real(*a).withColumn("track", F.col("track") + F.col("frame") % 2))
    assert catalog.QUERIES["greedy_track_assignment"](spark, sf_dir).where("faults > 0").count() > 0
    monkeypatch.setattr(tracking, "stabilise", lambda *a: real(*a).withColumn("mode", F.lit("static")))
    assert catalog.QUERIES["anchor_static_runs"](spark, sf_dir).where("faults > 0").count() > 0


def test_published_timeline_has_every_source(spark, duck, sf_dir):
    got = {r.source_id for r in catalog.QUERIES["published_timeline"](spark, sf_dir).select("source_id").distinct().collect()}
    local = duck.execute("SELECT DISTINCT user_id FROM events WHERE event_id % 7 <> 0 AND event_id % 11 <> 0").fetchall()
    assert got == {r[0] for r in local} and len(got) > 1


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
