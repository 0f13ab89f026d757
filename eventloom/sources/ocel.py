"""Readers of object-centric logs: (eid, activity, us, oid, otype) rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

PREFIX = "ocel:type:"
EVENTS = "`ocel:events` map<string, struct<`ocel:activity`: string, `ocel:timestamp`: string, `ocel:omap`: array<string>>>"
OBJECTS = "`ocel:objects` map<string, struct<`ocel:type`: string>>"


def read_csv(spark: SparkSession, path: str) -> DataFrame:
    """From an extended table: a column for each object type, whose cells list objects, as in "['i4', 'i1']"."""
    t = spark.read.csv(path, header=True, escape='"')
    kinds = [c for c in t.columns if c.startswith(PREFIX)]

    def held(column: str):
        ids = F.regexp_extract_all(F.coalesce(F.col(f"`{column}`"), F.lit("")), F.lit("'([^']*)'"), F.lit(1))
        return F.transform(ids, lambda o: F.struct(o.alias("oid"), F.lit(column.removeprefix(PREFIX)).alias("otype")))

    rows = t.select(F.col("`ocel:eid`").alias("eid"), F.col("`ocel:activity`").alias("activity"), F.unix_micros(F.col("`ocel:timestamp`").cast("timestamp")).alias("us"), F.explode(F.concat(*map(held, kinds))).alias("o"))
    return rows.select("eid", "activity", "us", "o.oid", "o.otype")


def read_json(spark: SparkSession, path: str) -> DataFrame:
    """From JSON-OCEL 1.0: a file is one document, so a log of many files is read file by file."""
    doc = spark.read.text(path, wholetext=True).select(F.from_json("value", f"{EVENTS}, {OBJECTS}").alias("d"))
    e = doc.select(F.explode("d.`ocel:events`").alias("eid", "e"))
    rel = e.select("eid", F.col("e.`ocel:activity`").alias("activity"), F.unix_micros(F.col("e.`ocel:timestamp`").cast("timestamp")).alias("us"), F.explode("e.`ocel:omap`").alias("oid"))
    o = doc.select(F.explode("d.`ocel:objects`").alias("oid", "o")).select("oid", F.col("o.`ocel:type`").alias("otype"))
    return rel.join(o, "oid").select("eid", "activity", "us", "oid", "otype")


def write_csv(relations: DataFrame, path: str) -> None:
    """An extended table: one row for each event."""
    kinds = [r[0] for r in relations.select("otype").distinct().orderBy("otype").collect()]  # object types: model-sized
    cells = [F.sort_array(F.collect_set(F.when(F.col("otype") == k, F.concat(F.lit("'"), F.col("oid"), F.lit("'"))))) for k in kinds]
    out = relations.groupBy(F.col("eid").alias("ocel:eid"), F.col("activity").alias("ocel:activity"), F.timestamp_micros("us").alias("ocel:timestamp")).agg(*(F.concat(F.lit("["), F.concat_ws(", ", c), F.lit("]")).alias(PREFIX + k) for k, c in zip(kinds, cells)))
    out.write.mode("overwrite").csv(path, header=True, escape='"')
