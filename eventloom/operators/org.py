"""Organisational mining."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from ..log import case_order


def handover(log: DataFrame) -> DataFrame:
    """Share of all handovers (successive events) by pair of resources."""
    p = log.select(F.col("resource").alias("source"), F.lead("resource").over(case_order()).alias("target")).where("source is not null and target is not null")
    n = p.groupBy("source", "target").agg(F.count("*").alias("n"))
    return n.select("source", "target", "n", F.round(F.col("n") / F.sum("n").over(Window.partitionBy(F.lit(1))), 8).alias("weight"))


def working_together(log: DataFrame) -> DataFrame:
    """Cases that two resources share, from each resource's cases once."""
    r = log.where("resource is not null").select("case_id", "resource").distinct()
    per_case = r.groupBy("case_id").agg(F.array_sort(F.collect_set("resource")).alias("rs"))
    pairs = per_case.select(F.explode("rs").alias("a"), "rs").select("a", F.explode("rs").alias("b")).where("a < b")
    return pairs.groupBy("a", "b").agg(F.count("*").alias("cases"))


def activity_resource(log: DataFrame) -> DataFrame:
    return log.where("resource is not null").groupBy("activity", "resource").agg(F.count("*").alias("n"))


def similar_activities(log: DataFrame) -> DataFrame:
    """Pearson correlation of the activity counts of two resources, over all activities."""
    m = activity_resource(log)
    acts = m.select("activity").distinct().count()
    own = m.groupBy("resource").agg(F.sum("n").alias("s"), F.sum(F.col("n") * F.col("n")).alias("q"))
    x = m.select("activity", F.col("resource").alias("a"), F.col("n").alias("x"))
    y = m.select("activity", F.col("resource").alias("b"), F.col("n").alias("y"))
    dot = x.join(y, "activity").where("a < b").groupBy("a", "b").agg(F.sum(F.col("x") * F.col("y")).alias("p"))
    A, B = own.select(F.col("resource").alias("a"), F.col("s").alias("sa"), F.col("q").alias("qa")), own.select(F.col("resource").alias("b"), F.col("s").alias("sb"), F.col("q").alias("qb"))
    n = F.lit(acts)
    spread = F.sqrt(n * F.col("qa") - F.col("sa") ** 2) * F.sqrt(n * F.col("qb") - F.col("sb") ** 2)
    r = (n * F.col("p") - F.col("sa") * F.col("sb")) / F.nullif(spread, F.lit(0.0))  # null for a resource equally busy everywhere
    pairs = A.crossJoin(B).where("a < b").join(dot, ["a", "b"], "left").withColumn("p", F.coalesce("p", F.lit(0)))  # no common activity: 0
    return pairs.select("a", "b", F.round(r, 6).alias("similarity"))


def profile(log: DataFrame) -> DataFrame:
    """For each resource: events, distinct activities, cases, days worked."""
    return log.where("resource is not null").groupBy("resource").agg(F.count("*").alias("events"), F.count_distinct("activity").alias("activities"), F.count_distinct("case_id").alias("cases"), F.count_distinct(F.floor(F.col("us") / 86_400_000_000)).alias("days"))


def working_together_weight(log: DataFrame) -> DataFrame:
    """Cases that two resources share, both ways, over the number of events of the log."""
    w = working_together(log)
    both = w.unionByName(w.select(F.col("b").alias("a"), F.col("a").alias("b"), "cases"))
    return both.join(F.broadcast(log.agg(F.count("*").alias("total")))).select("a", "b", F.round(F.col("cases") / F.col("total"), 8).alias("weight"))


def subcontracting(log: DataFrame, n: int = 2) -> DataFrame:
    """Handing work over and getting it back n events later, over the cases of the log."""
    w = case_order()
    p = log.where("resource is not null").select("case_id", F.col("resource").alias("source"), F.lead("resource", n).over(w).alias("again"), F.array(*(F.lead("resource", i).over(w) for i in range(1, n))).alias("between"))
    c = p.where("source = again").select("source", F.explode("between").alias("target")).groupBy("source", "target").agg(F.count("*").alias("n"))
    return c.join(F.broadcast(log.agg(F.count_distinct("case_id").alias("cases")))).select("source", "target", "n", F.round(F.col("n") / F.col("cases"), 8).alias("weight"))


def network(log: DataFrame) -> DataFrame:
    """Edges between resources of successive events, by the activity that hands over: frequency and mean seconds."""
    w = case_order()
    p = log.select(F.col("resource").alias("source"), "activity", F.lead("resource").over(w).alias("target"), (F.lead("us").over(w) - F.col("us")).alias("g")).where("source is not null and target is not null")
    return p.groupBy("source", "target", "activity").agg(F.count("*").alias("n"), (F.sum("g").cast("double") / F.count("*") / 1e6).alias("mean_s"))


def distinct_activities(log: DataFrame) -> DataFrame:
    """For each resource: activities, frequency of the most frequent, share of all events (its fraction), and cases completed by it."""
    r = log.where("resource is not null").groupBy("resource", "activity").agg(F.count("*").alias("n")).groupBy("resource").agg(F.count("*").alias("activities"), F.max("n").alias("most"), F.sum("n").alias("n"))
    last = log.groupBy("case_id").agg(F.max_by("resource", F.struct("us", "event_idx")).alias("resource")).groupBy("resource").agg(F.count("*").alias("completed"))
    total = log.agg(F.count("*").alias("total"))
    return r.join(last, "resource", "left").join(F.broadcast(total)).select("resource", "activities", "most", F.round(F.col("n") / F.col("total"), 8).alias("fraction"), F.coalesce("completed", F.lit(0)).alias("completed"))
