"""Directly- and eventually-follows relations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..log import case_order


def pairs(log: DataFrame, step: int = 1) -> DataFrame:
    """Each event and the one `step` later in its case: source, target, gap_s, and cost if the log has it."""
    own = [c for c in ("case_id", "cost") if c in log.columns]
    nxt = log.select(*own, F.col("activity").alias("source"), F.lead("activity", step).over(case_order()).alias("target"), ((F.lead("us", step).over(case_order()) - F.col("us")) / 1e6).alias("gap_s"))
    return nxt.where("target is not null")


def frequency(log: DataFrame, step: int = 1) -> DataFrame:
    return pairs(log, step).groupBy("source", "target").agg(F.count("*").alias("frequency"))


def once_per_case(log: DataFrame) -> DataFrame:
    return pairs(log).groupBy("source", "target").agg(F.count_distinct("case_id").alias("cases"))


def spread(us: Column) -> dict[str, Column]:
    """Mean, median, extremes, sum and deviation in seconds of whole microseconds: sums are exact, so no order of rows changes them."""
    n, total, squares = F.count(us), F.sum(us), F.sum(us.cast("decimal(20,0)") * us.cast("decimal(18,0)"))
    s = total.cast("double")
    variance = F.when(n > 1, (squares.cast("double") - s * s / n) / (n - 1))
    return {"mean_s": s / n / 1e6, "median_s": F.percentile(us, 0.5) / 1e6, "min_s": F.min(us) / 1e6, "max_s": F.max(us) / 1e6, "sum_s": s / 1e6, "stdev_s": F.round(F.sqrt(F.greatest(variance, F.lit(0.0))) / 1e6, 3)}


def performance(log: DataFrame) -> DataFrame:
    """Directly-follows pairs with the spread of their gaps in seconds; no deviation for a single pair."""
    at = F.lead("us").over(case_order()) - F.col("us")
    p = log.select(F.col("activity").alias("source"), F.lead("activity").over(case_order()).alias("target"), at.alias("gap_us")).where("target is not null")
    return p.groupBy("source", "target").agg(*(c.alias(k) for k, c in spread(F.col("gap_us")).items()))


def cost(log: DataFrame) -> DataFrame:
    return pairs(log).groupBy("source", "target").agg(F.round(F.sum("cost"), 4).alias("cost"))


def triples(log: DataFrame) -> DataFrame:
    t = log.select(F.col("activity").alias("a"), F.lead("activity", 1).over(case_order()).alias("b"), F.lead("activity", 2).over(case_order()).alias("c"))
    return t.where("c is not null").groupBy("a", "b", "c").agg(F.count("*").alias("n"))


def eventually_follows(log: DataFrame) -> DataFrame:
    """Pairs of events of a case, the first strictly before the second: counted from running counts for each activity, so work grows with events x activities, not with a case's square."""
    acts = [r[0] for r in log.select("activity").distinct().orderBy("activity").collect()]  # a log's alphabet: model-sized
    n = F.count("*").over(Window.partitionBy("case_id", "activity").orderBy("us", "event_idx"))
    numbered = log.select("case_id", "activity", "us", "event_idx", n.alias("k"))
    # for each event, the latest count of every source so far in its case
    w = Window.partitionBy("case_id", "source").orderBy("us", "event_idx").rowsBetween(Window.unboundedPreceding, -1)
    grid = numbered.withColumn("source", F.explode(F.array(*map(F.lit, acts))))
    seen = grid.withColumn("before", F.coalesce(F.max(F.when(F.col("activity") == F.col("source"), F.col("k"))).over(w), F.lit(0)))
    return seen.groupBy("source", F.col("activity").alias("target")).agg(F.sum("before").cast("long").alias("frequency")).where("frequency > 0")


def dependency(log: DataFrame) -> DataFrame:
    """The causal measure (|a>b| - |b>a|) / (|a>b| + |b>a| + 1) of each pair that follows either way, in both directions; loops have 0."""
    f = frequency(log)
    back = f.select(F.col("target").alias("source"), F.col("source").alias("target"), F.lit(0).cast("long").alias("there"), F.col("frequency").alias("back"))
    both = f.select("source", "target", F.col("frequency").alias("there"), F.lit(0).cast("long").alias("back")).unionByName(back)
    n = both.groupBy("source", "target").agg(F.sum("there").alias("there"), F.sum("back").alias("back"))
    return n.select("source", "target", F.round((F.col("there") - F.col("back")) / (F.col("there") + F.col("back") + 1), 6).alias("dependency"))


def heuristics_dependency(log: DataFrame) -> DataFrame:
    """The heuristics net's measure of each edge: as `dependency`, but |a>a| / (|a>a| + 1) for loops."""
    f = frequency(log)
    r = f.select(F.col("source").alias("target"), F.col("target").alias("source"), F.col("frequency").alias("back"))
    ab, ba = F.col("frequency"), F.coalesce("back", F.lit(0))
    d = F.when(F.col("source") == F.col("target"), ab / (ab + 1)).otherwise((ab - ba) / (ab + ba + 1))
    return f.join(r, ["source", "target"], "left").select("source", "target", F.round(d, 6).alias("dependency"))


def causal_alpha(log: DataFrame, share: float = 0.0) -> DataFrame:
    """Pairs that follow one way only, among the edges that `noise_filtered` leaves."""
    f = noise_filtered(log, share).select("source", "target")
    return f.join(f.select(F.col("source").alias("target"), F.col("target").alias("source")), ["source", "target"], "left_anti")


def footprints(log: DataFrame) -> DataFrame:
    """Relation of each pair of activities that follow one another either way: -> or ||."""
    f = frequency(log).select("source", "target")
    back = f.select(F.col("source").alias("target"), F.col("target").alias("source"), F.lit(1).alias("both"))
    return f.join(back, ["source", "target"], "left").select("source", "target", F.when(F.col("both") == 1, "||").otherwise("->").alias("relation"))


def min_self_distance(log: DataFrame) -> DataFrame:
    at = log.select("case_id", "activity", "us", "event_idx", F.row_number().over(case_order()).alias("p"))
    w = Window.partitionBy("case_id", "activity").orderBy("p")
    return at.withColumn("d", F.lead("p").over(w) - F.col("p") - 1).where("d is not null").groupBy("activity").agg(F.min("d").cast("long").alias("distance"))


def noise_filtered(log: DataFrame, share: float = 0.2) -> DataFrame:
    """Edges of at least `share` of the strongest edge, in or out, of that one of their ends whose strongest is weaker."""
    f = frequency(log)
    ends = f.select(F.col("source").alias("act"), "frequency").unionByName(f.select(F.col("target").alias("act"), "frequency"))
    most = ends.groupBy("act").agg(F.max("frequency").alias("most"))
    of = lambda end: most.select(F.col("act").alias(end), F.col("most").alias(f"most_{end}"))
    least = F.least("most_source", "most_target") * share
    return f.join(of("source"), "source").join(of("target"), "target").where(F.col("frequency") >= least).select("source", "target", "frequency")
