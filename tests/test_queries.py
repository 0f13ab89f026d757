"""Every registered event-log query equals its SQL in DuckDB; streams equal their batch twins."""

import pandas as pd
import pytest

from eventloom.log import click_log
from eventloom.operators import dfg
from eventloom.plans import registry
from tests import oracle

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    return oracle.connect(SF)


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_equals_sql(spark, duck, name):
    run, sql = registry.WITH[name]
    assert oracle.differ(spark, duck, SF, run, sql) is None


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).columns == ["source", "target", "frequency"]
    assert set(e.oracle_sql()) <= set(e.queries())


def test_stream_equals_batch(spark, tmp_path):
    from eventloom.streaming.dfg import stream_dfg

    log = click_log(spark, SF).select("case_id", "activity", "us", "event_idx", "cost")
    for i, (lo, hi) in enumerate(((0, 0.5), (0.5, 1.1))):
        q = log.approxQuantile("us", [0.5], 0)[0]
        part = log.where(f"us {'<=' if i == 0 else '>'} {q}")
        part.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(log.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    query = stream_dfg(stream).writeStream.format("memory").queryName("dfg_stream").option("checkpointLocation", str(tmp_path / "cp")).start()
    query.processAllAvailable()
    query.stop()
    got = spark.sql("select source, target, sum(n) frequency from dfg_stream group by 1, 2").toPandas()
    want = dfg.frequency(log).toPandas()
    key = ["source", "target"]
    pd.testing.assert_frame_equal(got.sort_values(key).reset_index(drop=True), want.sort_values(key).reset_index(drop=True), check_dtype=False)


def test_csv_and_xes(spark, tmp_path):
    from eventloom.sources import logs

    (tmp_path / "a.csv").write_text("case:concept:name,concept:name,time:timestamp,x\n1,a,2024-01-01 00:00:00,5\n1,b,2024-01-02 00:00:00,6\n,c,2024-01-02 00:00:00,7\n")
    got = logs.read_csv(spark, str(tmp_path / "a.csv"))
    assert [(r.case_id, r.activity, r.x) for r in got.orderBy("us").collect()] == [("1", "a", "5"), ("1", "b", "6")]
    (tmp_path / "a.xes").write_text('<log><trace><string key="concept:name" value="c1"/><event><string key="concept:name" value="a"/><date key="time:timestamp" value="2024-01-01T00:00:00Z"/><int key="n" value="3"/></event><event><string key="concept:name" value="b"/><string key="org:resource" value="r"/><date key="time:timestamp" value="2024-01-01T01:00:00Z"/></event></trace></log>')
    rows = logs.read_xes(spark, str(tmp_path / "a.xes")).orderBy("event_idx").collect()
    assert [(r.case_id, r.activity, r.resource) for r in rows] == [("c1", "a", None), ("c1", "b", "r")]
    assert rows[0].attributes["n"] == "3" and rows[1].us - rows[0].us == 3_600_000_000
