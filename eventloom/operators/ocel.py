"""Object-centric logs: events related to objects of several types."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, functions as F


def order_relations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(eid, activity, us, oid, otype): orders are placed and their lines shipped; objects are orders, customers, parts and suppliers."""
    o = spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey", "o_custkey", "o_orderdate")
    li = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_shipdate")
    us = lambda c: F.unix_micros(F.col(c).cast("timestamp"))
    s = lambda p, c: F.concat(F.lit(p), F.col(c).cast("string"))
    place = o.select(s("p", "o_orderkey").alias("eid"), F.lit("place").alias("activity"), us("o_orderdate").alias("us"), F.array(F.struct(s("o", "o_orderkey").alias("oid"), F.lit("order").alias("otype")), F.struct(s("c", "o_custkey").alias("oid"), F.lit("customer").alias("otype"))).alias("r"))
    ship = li.select(F.concat(s("s", "l_orderkey"), s("-", "l_linenumber")).alias("eid"), F.lit("ship").alias("activity"), us("l_shipdate").alias("us"), F.array(F.struct(s("o", "l_orderkey").alias("oid"), F.lit("order").alias("otype")), F.struct(s("i", "l_partkey").alias("oid"), F.lit("part").alias("otype")), F.struct(s("u", "l_suppkey").alias("oid"), F.lit("supplier").alias("otype"))).alias("r"))
    return place.unionByName(ship).select("eid", "activity", "us", F.explode("r").alias("r")).select("eid", "activity", "us", "r.oid", "r.otype")


def flatten(rel: DataFrame, otype: str) -> DataFrame:
    """A flat log for one object type: a case for each object."""
    return rel.where(F.col("otype") == otype).select(F.col("oid").alias("case_id"), "activity", "us", F.col("eid").alias("event_idx"))


def ocdfg(rel: DataFrame) -> DataFrame:
    """Directly-follows for each object type: event couples and distinct objects."""
    w = Window.partitionBy("otype", "oid").orderBy("us", "eid")
    p = rel.select("otype", "oid", "eid", F.col("activity").alias("source"), F.lead("activity").over(w).alias("target"), F.lead("eid").over(w).alias("next")).where("target is not null")
    return p.groupBy("otype", "source", "target").agg(F.count_distinct("eid", "next").alias("event_couples"), F.count_distinct("oid").alias("unique_objects"), F.count("*").alias("total_objects"))


def object_summary(rel: DataFrame) -> DataFrame:
    """For each type: objects, and the least and most events of one."""
    o = rel.groupBy("otype", "oid").agg(F.count("*").alias("n"))
    return o.groupBy("otype").agg(F.count("*").alias("objects"), F.min("n").alias("fewest"), F.max("n").alias("most"))


def type_activities(rel: DataFrame) -> DataFrame:
    return rel.groupBy("otype", "activity").agg(F.count_distinct("eid").alias("events"), F.count_distinct("oid").alias("objects"))


def objects_per_event(rel: DataFrame) -> DataFrame:
    n = rel.groupBy("eid", "activity", "otype").agg(F.count("*").alias("n"))
    return n.groupBy("activity", "otype").agg(F.min("n").alias("fewest"), F.max("n").alias("most"))


def events_where(rel: DataFrame, condition) -> DataFrame:
    """Relations of the events that meet a condition on event columns (activity, us, eid)."""
    return rel.where(condition)


def object_types(rel: DataFrame, types: list[str], keep: bool = True) -> DataFrame:
    """Relations to objects of the types; events without one are gone with their relations."""
    c = F.col("otype").isin(types)
    return rel.where(c if keep else ~c)


def objects(rel: DataFrame, ids: list[str], keep: bool = True) -> DataFrame:
    c = F.col("oid").isin(ids)
    return rel.where(c if keep else ~c)


def allowed_activities(rel: DataFrame, allowed: dict[str, list[str]]) -> DataFrame:
    """Relations of the named types with events of the activities allowed for each."""
    ok = F.lit(False)
    for otype, activities in allowed.items():
        ok = ok | ((F.col("otype") == otype) & F.col("activity").isin(activities))
    return rel.where(ok)


def per_type_count(rel: DataFrame, least: dict[str, int]) -> DataFrame:
    """Relations of the events that have at least so many objects of every named type."""
    n = rel.groupBy("eid").agg(*(F.count_if(F.col("otype") == t).alias(f"n{i}") for i, t in enumerate(least)))
    ok = F.lit(True)
    for i, k in enumerate(least.values()):
        ok = ok & (F.col(f"n{i}") >= k)
    return rel.join(n.where(ok), "eid", "left_semi")


def end_events(rel: DataFrame, otype: str, last: bool = False) -> DataFrame:
    """Relations of the events that begin (or end) the life of an object of the type."""
    pick = F.max if last else F.min
    e = rel.where(F.col("otype") == otype).groupBy("oid").agg(pick(F.struct("us", "eid")).alias("e"))
    return rel.join(e.select(F.col("e.eid").alias("eid")).distinct(), "eid", "left_semi")


def objects_summary(rel: DataFrame) -> DataFrame:
    """A row for each object: type, activities in order, first and last time, seconds between."""
    e = F.array_sort(F.collect_list(F.struct("us", "eid", "activity")))
    o = rel.groupBy("oid", "otype").agg(e.alias("e"), F.min("us").alias("start_us"), F.max("us").alias("end_us"))
    return o.select("oid", "otype", F.array_join(F.transform("e", lambda x: x["activity"]), ",").alias("lifecycle"), "start_us", "end_us", ((F.col("end_us") - F.col("start_us")) / 1e6).alias("duration_s"))


def interactions(rel: DataFrame, most: int | None = None) -> DataFrame:
    """How many events relate objects of two types: type pairs, from each event's types once."""
    t = rel.groupBy("eid").agg(F.array_sort(F.collect_set("otype")).alias("ts"))
    pairs = t.select(F.explode("ts").alias("a"), "ts").select("a", F.explode("ts").alias("b")).where("a < b")
    return pairs.groupBy("a", "b").agg(F.count("*").alias("events"))


def object_graph(rel: DataFrame, kind: str = "interaction") -> DataFrame:
    """Edges between types, counted by distinct object pairs: `interaction` (one event has both) or `codeath` and `cobirth` (it also ends or begins both)."""
    r = rel.select("eid", "oid", "otype", "us")
    if kind != "interaction":
        w = Window.partitionBy("oid").orderBy(*([F.desc("us"), F.desc("eid")] if kind == "codeath" else ["us", "eid"]))
        r = r.withColumn("k", F.row_number().over(w)).where("k = 1").drop("k")
    x, y = (r.select("eid", F.col("oid").alias(a), F.col("otype").alias(t)) for a, t in (("a", "type_a"), ("b", "type_b")))
    return x.join(y, "eid").where("a < b").select("a", "b", "type_a", "type_b").distinct().groupBy("type_a", "type_b").agg(F.count("*").alias("pairs"))
