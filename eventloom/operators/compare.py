"""Log-against-log comparison: each report is one pass over both logs, with the log as a grouping key."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..log import traces
from .dfg import pairs


def split(log: DataFrame) -> DataFrame:
    """Marks a case's log: `original` for even case ids, `simulated` for odd."""
    return log.withColumn("log", F.when(F.col("case_id") % 2 == 0, "original").otherwise("simulated"))


def _both(counts: DataFrame, keys: list[str]) -> DataFrame:
    a = F.sum(F.when(F.col("log") == "original", F.col("n")).otherwise(0)).alias("original")
    b = F.sum(F.when(F.col("log") == "simulated", F.col("n")).otherwise(0)).alias("simulated")
    return counts.groupBy(*keys).agg(a, b)


def activities(log: DataFrame) -> DataFrame:
    return _both(log.groupBy("log", "activity").agg(F.count("*").alias("n")), ["activity"])


def edges(log: DataFrame) -> DataFrame:
    p = pairs(log.withColumn("case_id", F.struct("log", "case_id"))).withColumn("log", F.col("case_id.log"))
    return _both(p.groupBy("log", "source", "target").agg(F.count("*").alias("n")), ["source", "target"])


def variants(log: DataFrame) -> DataFrame:
    t = traces(log.withColumn("case_id", F.struct("log", "case_id")))
    n = t.groupBy(F.col("case_id.log").alias("log"), "trace").agg(F.count("*").alias("n"))
    return _both(n, ["trace"]).select(F.concat_ws(",", "trace").alias("variant"), "original", "simulated")


def durations(log: DataFrame) -> DataFrame:
    d = log.groupBy("log", "case_id").agg(((F.max("us") - F.min("us")) / 1e6).alias("d"))
    return d.groupBy("log").agg(F.count("*").alias("cases"), *(F.round(c, 4).alias(n) for n, c in {"mean_s": F.avg("d"), "std_s": F.stddev_samp("d"), "p25_s": F.percentile("d", 0.25), "median_s": F.percentile("d", 0.5), "p75_s": F.percentile("d", 0.75), "max_s": F.max("d")}.items()))


def daily(log: DataFrame, last: bool = False) -> DataFrame:
    """Cases that arrive (or complete) on each day since 1970, by log."""
    at = F.max("us") if last else F.min("us")
    c = log.groupBy("log", "case_id").agg(at.alias("at")).groupBy("log", F.floor(F.col("at") / 86_400_000_000).alias("day")).agg(F.count("*").alias("n"))
    return _both(c, ["day"])


def shares(log: DataFrame) -> DataFrame:
    """Each activity's share of its log's events, and the difference."""
    a = activities(log)
    total = a.agg(F.sum("original").alias("o"), F.sum("simulated").alias("s"))
    x, y = F.col("original") / F.nullif(F.col("o"), F.lit(0)), F.col("simulated") / F.nullif(F.col("s"), F.lit(0))
    return a.join(F.broadcast(total)).select("activity", F.round(x, 6).alias("original"), F.round(y, 6).alias("simulated"), F.round(F.abs(x - y), 6).alias("difference"))


def overlap(log: DataFrame) -> DataFrame:
    """Jaccard similarity of the logs' sets of activities, edges and variants, and the shares of cases and edges in common ones."""
    out = None
    for name, counts in (("activities", activities(log)), ("edges", edges(log)), ("variants", variants(log))):
        both = (F.col("original") > 0) & (F.col("simulated") > 0)
        share = lambda c: F.round(F.sum(F.when(both, F.col(c)).otherwise(0)) / F.nullif(F.sum(c), F.lit(0)), 6)  # noqa: E731, B023
        row = counts.agg(F.lit(name).alias("kind"), F.round(F.count_if(both) / F.nullif(F.count("*"), F.lit(0)), 6).alias("jaccard"), share("original").alias("original_in_common"), share("simulated").alias("simulated_in_common"))
        out = row if out is None else out.unionByName(row)
    return out
