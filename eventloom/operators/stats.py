"""Log, case and variant statistics."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from ..log import case_order, traces, variants

#: Times are cut into ranges of this length, so that no task orders a whole log.
RANGE_US = 3_600_000_000


def cases(log: DataFrame) -> DataFrame:
    return log.groupBy("case_id").agg(F.count("*").alias("n_events"), F.min("us").alias("start_us"), F.max("us").alias("end_us"))


def case_durations(log: DataFrame) -> DataFrame:
    return cases(log).select("case_id", F.round((F.col("end_us") - F.col("start_us")) / 1e6, 4).alias("duration_s"))


def endpoints(log: DataFrame, last: bool = False) -> DataFrame:
    pick = F.max_by if last else F.min_by
    return log.groupBy("case_id").agg(pick("activity", F.struct("us", "event_idx")).alias("activity")).groupBy("activity").agg(F.count("*").alias("n"))


def attribute_values(log: DataFrame, column: str, per_case: bool = False) -> DataFrame:
    n = F.count_distinct("case_id") if per_case else F.count("*")
    return log.where(F.col(column).isNotNull()).groupBy(F.col(column).alias("value")).agg(n.alias("n"))


#: Values of each unit of time that are given even if no event has them.
UNITS = {"hour": (0, 23), "weekday": (0, 6), "day": (1, 31), "week": (0, 52), "month": (1, 12)}


def distribution(log: DataFrame, unit: str) -> DataFrame:
    """Events by a unit of time, Monday being weekday 0; values without events have 0, as have years between the first and the last."""
    ts = F.timestamp_micros("us")
    part = {"hour": F.hour(ts), "weekday": F.weekday(ts), "day": F.dayofmonth(ts), "week": F.weekofyear(ts), "month": F.month(ts), "year": F.year(ts)}[unit]
    found = log.groupBy(part.cast("long").alias(unit)).agg(F.count("*").alias("n"))
    low, high = (F.lit(v).cast("long") for v in UNITS[unit]) if unit in UNITS else (F.min(unit), F.max(unit))
    ends = found.agg(F.min(unit).alias("lo"), F.max(unit).alias("hi")) if unit not in UNITS else None
    every = log.sparkSession.range(1).select(F.explode(F.sequence(low, high)).alias(unit)) if ends is None else ends.where("lo is not null").select(F.explode(F.sequence("lo", "hi")).alias(unit))
    return found.unionByName(every.withColumn("n", F.lit(0).cast("long"))).groupBy(unit).agg(F.sum("n").alias("n"))


def gaps(log: DataFrame, end: bool = False) -> DataFrame:
    """Seconds from the previous case's start (or end) to each case's; 0 for the first. The first of a range of time follows the last of the range before."""
    at = F.col("end_us" if end else "start_us")
    c = cases(log).select("case_id", at.alias("at"), F.floor(at / RANGE_US).alias("r"))
    earlier = c.groupBy("r").agg(F.max("at").alias("top")).select("r", F.lag("top").over(Window.orderBy("r")).alias("before"))
    own = F.lag("at").over(Window.partitionBy("r").orderBy("at", "case_id"))
    return c.withColumn("own", own).join(earlier, "r").select("case_id", F.round(F.coalesce((F.col("at") - F.coalesce("own", "before")) / 1e6, F.lit(0.0)), 4).alias("gap_s"))


def arrival_average(log: DataFrame, end: bool = False) -> DataFrame:
    """Mean gap between case starts (or ends): from the extremes and the count, no ordering needed; null for a single case."""
    at = F.col("end_us" if end else "start_us")
    return cases(log).agg(F.round((F.max(at) - F.min(at)) / 1e6 / F.nullif(F.count("*") - 1, F.lit(0)), 4).alias("average_s"))


def rework_per_activity(log: DataFrame) -> DataFrame:
    """Cases in which an activity occurs more than once."""
    return log.groupBy("case_id", "activity").agg(F.count("*").alias("k")).where("k > 1").groupBy("activity").agg(F.count("*").alias("n"))


def rework_per_case(log: DataFrame) -> DataFrame:
    return log.groupBy("case_id").agg((F.count("*") - F.count_distinct("activity")).alias("rework"))


def variant_durations(log: DataFrame) -> DataFrame:
    d = traces(log).join(cases(log), "case_id")
    s = (F.col("end_us") - F.col("start_us")) / 1e6
    by = d.groupBy("trace").agg(F.count("*").alias("n"), F.round(F.avg(s), 4).alias("mean_s"))
    return by.select(F.concat_ws(",", "trace").alias("variant"), "n", "mean_s")


def top_variants(log: DataFrame, k: int) -> DataFrame:
    return variants(log).orderBy(F.desc("n"), F.desc("variant")).limit(k)


def stochastic_language(log: DataFrame) -> DataFrame:
    v = variants(log)
    total = v.agg(F.sum("n").alias("total"))
    return v.join(F.broadcast(total)).select("variant", F.round(F.col("n") / F.col("total"), 8).alias("p"))


def activity_positions(log: DataFrame) -> DataFrame:
    return log.select("activity", (F.row_number().over(case_order()) - 1).cast("long").alias("position")).groupBy("activity", "position").agg(F.count("*").alias("n"))


def case_overlap(log: DataFrame) -> DataFrame:
    """For each case, the cases whose closed time span meets its own, itself included: those that start by its end, less those that end before its start. Both are counted from the totals of earlier ranges of time and the ranks in the own range."""
    c = cases(log)
    point = lambda at, is_start: c.select("case_id", F.col(at).alias("at"), F.lit(is_start).alias("is_start"))
    p = point("start_us", 1).unionByName(point("end_us", 0)).withColumn("r", F.floor(F.col("at") / RANGE_US))
    before = Window.orderBy("r").rowsBetween(Window.unboundedPreceding, -1)
    total = p.groupBy("r").agg(F.sum("is_start").alias("starts"), F.sum(1 - F.col("is_start")).alias("ends"))
    earlier = total.select("r", *(F.coalesce(F.sum(k).over(before), F.lit(0)).alias(k) for k in ("starts", "ends")))
    w = Window.partitionBy("r").orderBy("at")
    upto = F.sum("is_start").over(w.rangeBetween(Window.unboundedPreceding, 0))
    ended = F.coalesce(F.sum(1 - F.col("is_start")).over(w.rangeBetween(Window.unboundedPreceding, -1)), F.lit(0))
    ranked = p.withColumns({"upto": upto, "ended": ended}).join(earlier, "r")
    part = F.when(F.col("is_start") == 1, -(F.col("ended") + F.col("ends"))).otherwise(F.col("upto") + F.col("starts"))
    return ranked.groupBy("case_id").agg(F.sum(part).cast("long").alias("overlap"))
