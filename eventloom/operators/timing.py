"""Business hours, and logs whose events last: service, waiting and cycle time.

An interval log has start_us and end_us beside the canonical columns.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from ..functions.business import WORKDAYS, business_seconds
from .compare import split
from .stats import RANGE_US, cases


def intervals(log: DataFrame, seconds) -> DataFrame:
    """A log whose events last: each begins at its time and ends `seconds` later."""
    return log.withColumns({"start_us": F.col("us"), "end_us": F.col("us") + (F.round(seconds) * 1_000_000).cast("long")})


def business_durations(log: DataFrame, slots=WORKDAYS) -> DataFrame:
    return cases(log).select("case_id", F.round(business_seconds(F.col("start_us"), F.col("end_us"), slots), 4).alias("business_s"))


def business_performance(log: DataFrame, slots=WORKDAYS) -> DataFrame:
    """Directly-follows pairs with the mean and sum of their gaps in business seconds."""
    w = Window.partitionBy("case_id").orderBy("us", "event_idx")
    p = log.select(F.col("activity").alias("source"), F.lead("activity").over(w).alias("target"), "us", F.lead("us").over(w).alias("then")).where("target is not null")
    g = business_seconds(F.col("us"), F.col("then"), slots)
    return p.groupBy("source", "target").agg(F.round(F.avg(g), 4).alias("mean_s"), F.round(F.sum(g), 4).alias("sum_s"))


def service_time(log: DataFrame) -> DataFrame:
    """How long events of each activity last."""
    d = (F.col("end_us") - F.col("start_us")) / 1e6
    return log.groupBy("activity").agg(*(F.round(c, 4).alias(n) for n, c in {"mean_s": F.avg(d), "median_s": F.percentile(d, 0.5), "min_s": F.min(d), "max_s": F.max(d), "sum_s": F.sum(d)}.items()))


def service_waiting(log: DataFrame) -> DataFrame:
    """For each case: time in events, from the first start to the last end, and the difference (below 0 where events overlap)."""
    service, sojourn = F.sum(F.col("end_us") - F.col("start_us")), F.max("end_us") - F.min("start_us")
    return log.groupBy("case_id").agg(*(F.round(c / 1e6, 4).alias(n) for n, c in {"service_s": service, "sojourn_s": sojourn, "waiting_s": sojourn - service}.items()))


def cycle_time(log: DataFrame) -> DataFrame:
    """Busy seconds (intervals of the whole log, merged) for each case; the last busy block doesn't count.

    Each interval adds what lies beyond the latest end before it. That end is the largest of earlier
    ranges of time (one row each) or of the own range's rows.
    """
    e = log.select("case_id", "start_us", "end_us", F.floor(F.col("start_us") / RANGE_US).alias("r"))
    per = e.groupBy("r").agg(F.max("end_us").alias("top"))
    earlier = per.select("r", F.max("top").over(Window.orderBy("r").rowsBetween(Window.unboundedPreceding, -1)).alias("before"))
    own = F.max("end_us").over(Window.partitionBy("r").orderBy("start_us", "end_us").rowsBetween(Window.unboundedPreceding, -1))
    x = e.withColumn("own", own).join(earlier, "r").select("start_us", "end_us", F.greatest("before", "own").alias("reached"))
    opens = F.col("reached").isNull() | (F.col("start_us") > F.col("reached"))
    busy = F.sum(F.greatest(F.col("end_us") - F.greatest("start_us", "reached"), F.lit(0)))
    last = F.max("end_us") - F.max(F.when(opens, F.col("start_us")))
    total = x.agg((busy - last).alias("busy"))
    n = log.agg(F.count_distinct("case_id").alias("n"))
    return total.join(F.broadcast(n)).select(F.round(F.col("busy") / 1e6 / F.col("n"), 4).alias("cycle_s"))


def compare_activity_durations(log: DataFrame) -> DataFrame:
    """Hours to the next event of the case, for each activity and log."""
    w = Window.partitionBy("case_id").orderBy("us", "event_idx")
    h = split(log).select("log", "activity", ((F.lead("us").over(w) - F.col("us")) / 3.6e9).alias("h")).where("h is not null")
    return h.groupBy("log", "activity").agg(F.round(F.avg("h"), 4).alias("mean_h"), F.round(F.percentile("h", 0.5), 4).alias("median_h"), F.round(F.percentile("h", 0.9), 4).alias("p90_h"))


def concurrent(log: DataFrame) -> DataFrame:
    """Pairs of activities of one case whose intervals meet, by unordered pair of events.

    A case's intervals are compared in its array, where the pairs are counted at once; work grows with a case's square.
    """
    rows = log.groupBy("case_id").agg(F.array_sort(F.collect_list(F.struct("start_us", "end_us", "event_idx", "activity"))).alias("e"))
    later = rows.select("e", F.posexplode("e").alias("i", "x")).select("x", F.explode(F.filter(F.slice("e", F.col("i") + 2, F.size("e")), lambda y: y["start_us"] <= F.col("x.end_us"))).alias("y"))
    return later.groupBy(F.least("x.activity", "y.activity").alias("a"), F.greatest("x.activity", "y.activity").alias("b")).agg(F.count("*").alias("n"))


def batches(log: DataFrame, distance_s: int = 900, least: int = 2) -> DataFrame:
    """(activity, resource, start_us, end_us, size, kind): intervals of one activity and resource that overlap or lie within a distance.

    A task sees one day of an activity and resource; what earlier days leave open is carried by a row for each day.
    Intervals of a case with equal times count once; events without a resource are in no batch.
    """
    key, order = ["activity", "resource"], F.struct("us", "end_us", "case_id")
    e = log.where("resource is not null").select(*key, "case_id", "us", "end_us").distinct().withColumn("day", F.floor(F.col("us") / 86_400_000_000))
    before = Window.partitionBy(*key).orderBy("day").rowsBetween(Window.unboundedPreceding, -1)
    inside = Window.partitionBy(*key, "day").orderBy("us", "end_us", "case_id")
    earlier = inside.rowsBetween(Window.unboundedPreceding, -1)
    days = e.groupBy(*key, "day").agg(F.max("end_us").alias("m"), F.max(order).alias("l"))
    days = days.select(*key, "day", F.max("m").over(before).alias("m"), F.max("l").over(before).getField("end_us").alias("l"))
    e = e.join(days, [*key, "day"]).withColumn("open", F.greatest("m", F.max("end_us").over(earlier))).withColumn("prev", F.coalesce(F.lag("end_us").over(inside), "l"))
    e = e.withColumn("begun", F.when(F.col("open").isNull() | (F.col("us") - F.col("open") > distance_s * 1_000_000), F.col("us")))
    marks = e.groupBy(*key, "day").agg(F.max("begun").alias("g"))
    marks = marks.select(*key, "day", F.max("g").over(before).alias("g"))
    e = e.join(marks, [*key, "day"]).withColumn("island", F.coalesce(F.max("begun").over(inside.rowsBetween(Window.unboundedPreceding, 0)), "g"))
    loose = F.count_if(F.col("begun").isNull() & (F.col("prev") != F.col("us"))).alias("loose")
    by = e.groupBy(*key, "island").agg(F.count("*").alias("size"), F.max("us").alias("s"), F.min("end_us").alias("f"), F.max("end_us").alias("end_us"), loose).where(F.col("size") >= least)
    same_start, same_end = F.col("island") == F.col("s"), F.col("f") == F.col("end_us")
    kind = F.when(same_start & same_end, "simultaneous").when(same_start, "same start").when(same_end, "same end").when(F.col("loose") == 0, "sequential").otherwise("concurrent")
    return by.select(*key, F.col("island").alias("start_us"), "end_us", "size", kind.alias("kind"))
