"""Object-centric readers and writer, logs from text, and business seconds at slot edges."""

import json

from pyspark.sql import functions as F

from eventloom.functions.business import DAY, business_seconds, merged
from eventloom.operators import sequences, timing
from eventloom.sources import logs, ocel

T = "2024-01-01 00:00:00"


def told(df):
    return sorted((r.eid, r.activity, r.oid, r.otype) for r in df.collect())


def test_ocel_csv_and_json(spark, tmp_path):
    (tmp_path / "a.csv").write_text(f'ocel:eid,ocel:activity,ocel:timestamp,ocel:type:item,ocel:type:order\ne1,pay,{T},"[\'i1\', \'i2\']","[\'o1\']"\ne2,ship,{T},,"[\'o1\']"\ne3,none,{T},,\n')
    want = [("e1", "pay", "i1", "item"), ("e1", "pay", "i2", "item"), ("e1", "pay", "o1", "order"), ("e2", "ship", "o1", "order")]
    got = ocel.read_csv(spark, str(tmp_path / "a.csv"))
    assert told(got) == want
    ocel.write_csv(got, str(tmp_path / "out"))
    assert told(ocel.read_csv(spark, str(tmp_path / "out"))) == want
    event = lambda a, o: {"ocel:activity": a, "ocel:timestamp": T, "ocel:omap": o, "ocel:vmap": {}}
    doc = {"ocel:events": {"e1": event("pay", ["i1", "i2", "o1"]), "e2": event("ship", ["o1"]), "e3": event("none", [])}, "ocel:objects": {k: {"ocel:type": t, "ocel:ovmap": {}} for k, t in (("i1", "item"), ("i2", "item"), ("o1", "order"))}}
    (tmp_path / "a.jsonocel").write_text(json.dumps(doc, indent=1))
    assert told(ocel.read_json(spark, str(tmp_path / "a.jsonocel"))) == want


def test_logs_from_strings_and_patterns(spark):
    log = logs.from_strings(spark, ["a,b,c", "a,c", "ab,c"])
    assert log.count() == 7
    cases = lambda *p: sorted({r.case_id for r in sequences.trace_segments(log, list(p)).collect()})
    assert cases(["a", "..."]) == ["0", "1"]
    assert cases(["...", "c"]) == ["0", "1", "2"]
    assert cases(["a", "...", "c"], ["ab", "c"]) == ["0", "1", "2"]
    assert cases(["a", "c"]) == ["1"]
    assert cases(["b"]) == []


def test_business_seconds(spark):
    monday = 1_704_067_200  # 2024-01-01
    spans = {(0, 7 * DAY): 180_000, (8 * 3600, 9 * 3600): 3600, (0, 7 * 3600): 0, (16 * 3600, DAY + 8 * 3600): 7200, (5 * DAY, 7 * DAY): 0, (7 * DAY + 17 * 3600, 8 * DAY): 0}
    df = spark.createDataFrame([((monday + a) * 1_000_000, (monday + b) * 1_000_000, float(w)) for (a, b), w in spans.items()], "a long, b long, w double")
    assert df.where(business_seconds(F.col("a"), F.col("b")) != F.col("w")).count() == 0
    assert merged([(5, 9), (0, 3), (2, 4), (9, 10)]) == [(0, 4), (5, 10)]


def test_cycle_time_leaves_out_the_last_block(spark):
    rows = [("x", 0, 10), ("x", 5, 12), ("y", 12, 14), ("y", 4000, 4010), ("y", 4005, 4006), ("z", 9000, 9999)]
    log = spark.createDataFrame([(c, a * 1_000_000, b * 1_000_000) for c, a, b in rows], "case_id string, start_us long, end_us long")
    assert timing.cycle_time(log).first().cycle_s == 8.0
