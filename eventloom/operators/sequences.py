"""Prefixes, training samples, spectra and patterns of traces."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, Window, functions as F

from ..log import case_order, traces


def first_events(log: DataFrame, n: int) -> DataFrame:
    """The first n events of each case."""
    return log.withColumn("_pos", F.row_number().over(case_order())).where(F.col("_pos") <= n).drop("_pos")


def positions(log: DataFrame) -> DataFrame:
    """Where each activity first stands in each case that has it, from 0."""
    p = log.select("case_id", "activity", (F.row_number().over(case_order()) - 1).cast("long").alias("p"))
    return p.groupBy("case_id", "activity").agg(F.min("p").alias("position"))


def samples(log: DataFrame, length: int, pad: str = "<pad>") -> DataFrame:
    """(case_id, event_idx, prefix, next_activity): each event but a case's first, and up to `length` activities before it, padded on the left."""
    w = Window.partitionBy("case_id").orderBy("us", "event_idx").rowsBetween(-length, -1)
    s = log.select("case_id", "event_idx", F.collect_list("activity").over(w).alias("seen"), F.col("activity").alias("next_activity")).where(F.size("seen") > 0)
    padding = F.array_repeat(F.lit(pad), F.lit(length) - F.size("seen"))
    return s.select("case_id", "event_idx", F.concat_ws(",", F.concat(padding, F.col("seen"))).alias("prefix"), "next_activity")


def spectrum(log: DataFrame, activities: list[str]) -> DataFrame:
    """Times (t0, t1, …) at which the activities follow one another, other activities passed over."""
    w = case_order()
    own = log.where(F.col("activity").isin(activities))
    hit = own.select("case_id", *(F.lead("activity", i).over(w).alias(f"a{i}") for i in range(len(activities))), *(F.lead("us", i).over(w).alias(f"t{i}") for i in range(len(activities))))
    for i, a in enumerate(activities):
        hit = hit.where(F.col(f"a{i}") == a)
    return hit.select("case_id", *(f"t{i}" for i in range(len(activities))))


def trace_segments(log: DataFrame, patterns: list[list[str]], positive: bool = True) -> DataFrame:
    """Cases whose whole trace is as one of the patterns says; "..." stands for any activities, or none."""
    end = "\x1f"
    one = "|".join("".join(f"(?:[^{end}]*{end})*" if a == "..." else re.escape(a) + end for a in p) for p in patterns)
    told = F.concat_ws("", F.transform("trace", lambda a: F.concat(a, F.lit(end)))).rlike(f"^(?:{one})$")
    return log.join(traces(log).where(told if positive else ~told).select("case_id"), "case_id", "left_semi")
