"""Every mesh query against its SQL, on the smallest tables."""

import os

import checking
import pytest

from wavemesh.plans.queries import ORACLE_SQL, QUERIES

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="the driver's tables aren't here")


@pytest.fixture(scope="module")
def con():
    return checking.connected(SF)


@pytest.mark.parametrize("name", list(QUERIES))
def test_query_equals_its_sql(spark, con, name):
    df = QUERIES[name](spark, SF)
    if name in ORACLE_SQL:
        checking.same(df, con, ORACLE_SQL[name])
    else:
        assert df.count() >= 0


def test_entry(spark):
    import __spark_entry__

    assert {r.status for r in __spark_entry__.entry(spark).collect()} == {"active", "degraded", "silent"}


def test_loops_that_end_too_early_raise(spark):
    from wavemesh.operators import graph

    chain = spark.createDataFrame([(i, i + 1) for i in range(4)], "a long, b long")
    with pytest.raises(RuntimeError):
        graph.reached(chain, spark.range(1).withColumnRenamed("id", "start"), most_steps=2)
    with pytest.raises(RuntimeError):
        graph.components(chain, most_rounds=1)


def test_last_hearing_collects_no_arrays(spark):
    plan = QUERIES["p2_last_hearing"](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert "collect_list" not in plan and "max(" in plan


def test_receptions_are_dealt_into_more_parts_as_they_grow(spark, monkeypatch):
    """A task of the receptions' join holds no more of a larger table; the rows stay the same."""
    from wavemesh.plans import views

    plain = views.Tables(spark, SF).mesh_rx
    monkeypatch.setattr(views, "ROWS_PER_TASK", 500)
    dealt = views.Tables(spark, SF).mesh_rx
    assert "Repartition" not in plain._jdf.queryExecution().optimizedPlan().toString()
    parts = views.Tables(spark, SF).lineitem.count() / 500
    assert dealt.rdd.getNumPartitions() >= parts > 4
    assert dealt.exceptAll(plain).isEmpty() and plain.exceptAll(dealt).isEmpty()


def test_receptions_are_dealt_however_many_shuffle_partitions_there_are(spark, monkeypatch):
    """Adaptive execution would put many small partitions together, so receptions and what meets relays are dealt by number."""
    from wavemesh.operators import reports
    from wavemesh.plans import views

    monkeypatch.setattr(views, "ROWS_PER_TASK", 500)
    spark.conf.set("spark.sql.shuffle.partitions", "50")
    try:
        t = views.Tables(spark, SF)
        assert 4 < t.parts < 50
        wasted = reports.redundant_relays(t.mesh_tx, t.mesh_rx, t.parts)
        for rows in (t.mesh_rx, wasted):
            assert rows.rdd.getNumPartitions() >= t.parts
        plain = reports.redundant_relays(t.mesh_tx, t.mesh_rx)
        assert wasted.count() > 0 and wasted.exceptAll(plain).isEmpty() and plain.exceptAll(wasted).isEmpty()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
