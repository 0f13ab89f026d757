"""The canonical event log: case_id, activity, us (microseconds since 1970), event_idx, resource, cost.

Events of a case are ordered by (us, event_idx) everywhere; rows without case, activity or time are no events.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F


def case_order():
    """A case's events in order."""
    return Window.partitionBy("case_id").orderBy("us", "event_idx")


def whole_case():
    return Window.partitionBy("case_id")


def normalize(df: DataFrame, case: str, activity: str, ts: str, idx: str, **others: str | Column) -> DataFrame:
    """A log from any table: names of the key columns, and further columns by name or expression."""
    more = [(c if isinstance(c, Column) else F.col(c)).alias(k) for k, c in others.items()]
    out = df.select(F.col(case).alias("case_id"), F.col(activity).alias("activity"), F.unix_micros(F.col(ts).cast("timestamp")).alias("us"), F.col(idx).alias("event_idx"), *more)
    return out.where("case_id is not null and activity is not null and us is not null")


def click_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events table as a log: a case for each user."""
    k = F.get_json_object("props", "$.k").cast("long") % 10
    return normalize(spark.read.parquet(f"{sf_dir}/events.parquet"), "user_id", "event_type", "ts", "event_id", resource=F.concat(F.lit("R"), k.cast("string")), cost="value")


def order_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The orders and lineitem tables as a log of short cases: an order is placed, its lines are shipped."""
    o, li = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("orders", "lineitem"))
    who = lambda mark, key, n: F.concat(F.lit(mark), (F.col(key) % n).cast("string"))
    line = F.expr("l_linenumber * 1000000000000 + l_partkey * 100000 + l_suppkey")  # line numbers may repeat
    o, li = o.withColumns({"act": F.lit("place"), "line": F.lit(0)}), li.withColumns({"act": F.concat(F.lit("ship "), F.col("l_returnflag")), "line": line})
    placed = normalize(o, "o_orderkey", "act", "o_orderdate", "line", resource=who("C", "o_custkey", 5), cost="o_totalprice")
    return placed.unionByName(normalize(li, "l_orderkey", "act", "l_shipdate", "line", resource=who("S", "l_suppkey", 7), cost="l_extendedprice"))


def traces(log: DataFrame) -> DataFrame:
    """(case_id, trace): the activities of each case, in order."""
    rows = F.array_sort(F.collect_list(F.struct("us", "event_idx", "activity")))
    return log.groupBy("case_id").agg(F.transform(rows, lambda x: x["activity"]).alias("trace"))


def variants(log: DataFrame) -> DataFrame:
    """(variant, n): distinct traces and their cases."""
    return traces(log).groupBy("trace").agg(F.count("*").alias("n")).select(F.concat_ws(",", "trace").alias("variant"), "n")
