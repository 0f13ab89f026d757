"""Logs with added events or columns, and logs divided by case."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..log import case_order, whole_case


def artificial_ends(log: DataFrame, start: str = "▶", end: str = "■") -> DataFrame:
    """An event one millisecond before each case's first, and one after its last; its other columns are null."""
    ends = log.groupBy("case_id").agg((F.min("us") - 1000).alias("s"), (F.max("us") + 1000).alias("e"))
    pair = F.explode(F.array(F.struct(F.lit(start).alias("activity"), F.col("s").alias("us")), F.struct(F.lit(end).alias("activity"), F.col("e").alias("us"))))
    return log.unionByName(ends.select("case_id", pair.alias("x")).select("case_id", "x.activity", "x.us"), allowMissingColumns=True)


def numbered(log: DataFrame, name: str = "position") -> DataFrame:
    """Each event's position in its case, from 0."""
    return log.withColumn(name, (F.row_number().over(case_order()) - 1).cast("long"))


def classified(log: DataFrame, *columns: str, joint: str = "+") -> DataFrame:
    """The activity of each event is made of several columns; events that lack one of them go."""
    return log.dropna(subset=list(columns)).withColumn("activity", F.concat_ws(joint, *columns))


def alphabet(log: DataFrame) -> DataFrame:
    """(activity, letter): activities in order, as letters from A on; a table of the alphabet's size."""
    rank = F.row_number().over(Window.orderBy("activity"))
    return log.select("activity").distinct().select("activity", F.char(F.lit(64) + rank).alias("letter"))


def _drawn(seed: int) -> Column:
    """A number from 0 to below 1 by the case's id and the seed."""
    return F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(str(seed)), F.col("case_id").cast("string"))), 1, 8), 16, 10).cast("double") / 2.0**32


def split(log: DataFrame, share: float = 0.8, seed: int = 0) -> tuple[DataFrame, DataFrame]:
    """(train, test): whole cases, by a hash of their ids, without a shuffle."""
    return log.where(_drawn(seed) < share), log.where(_drawn(seed) >= share)


def sample_cases(log: DataFrame, n: int, seed: int = 0) -> DataFrame:
    """The events of n cases (all, if there are fewer), those of the smallest hashes."""
    some = log.select("case_id").distinct().orderBy(_drawn(seed), "case_id").limit(n)
    return log.join(some, "case_id", "left_semi")


def lifted(log: DataFrame, column: str) -> DataFrame:
    """(case_id, column) of the cases in which all events have one value of the column."""
    return log.groupBy("case_id").agg(F.min(column).alias(column), F.max(column).alias("_m"), F.count(column).alias("_n"), F.count("*").alias("_all")).where((F.col(column) == F.col("_m")) & (F.col("_n") == F.col("_all"))).select("case_id", column)


def lifecycle(log: DataFrame) -> DataFrame:
    """Two events, start and complete, for each interval (us, end_us)."""
    pair = F.array(*(F.struct(F.lit(k).alias("transition"), F.col(c).alias("us")) for k, c in (("start", "us"), ("complete", "end_us"))))
    rest = [c for c in log.columns if c not in ("us", "end_us", "transition")]
    return log.select(*rest, F.explode(pair).alias("x")).select(*rest, "x.transition", "x.us")


def passed(log: DataFrame) -> DataFrame:
    """Seconds since the case began and until it ends, at each event."""
    s, e = F.min("us").over(whole_case()), F.max("us").over(whole_case())
    return log.withColumns({"since_s": (F.col("us") - s) / 1e6, "until_s": (e - F.col("us")) / 1e6})
