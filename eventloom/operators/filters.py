"""Filters of events and cases. Case filters are semi- or anti-joins on the cases that match; keep=False keeps the others."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..log import case_order, traces, whole_case
from .stats import cases


def keep_cases(log: DataFrame, found: DataFrame, keep: bool = True) -> DataFrame:
    return log.join(found.select("case_id").distinct(), "case_id", "left_semi" if keep else "left_anti")


def summary(log: DataFrame) -> DataFrame:
    return log.groupBy("case_id").agg(F.count("*").alias("n_events"))


def start(log: DataFrame, activities: list[str], keep: bool = True) -> DataFrame:
    first = F.first("activity").over(case_order())
    return log.withColumn("_f", first).where(F.col("_f").isin(activities) if keep else ~F.col("_f").isin(activities)).drop("_f")


def end(log: DataFrame, activities: list[str], keep: bool = True) -> DataFrame:
    found = log.groupBy("case_id").agg(F.max_by("activity", F.struct("us", "event_idx")).alias("a")).where(F.col("a").isin(activities))
    return keep_cases(log, found, keep)


def events(log: DataFrame, column: str, values: list, keep: bool = True) -> DataFrame:
    c = F.col(column).isin(values)
    return log.where(c if keep else ~F.coalesce(c, F.lit(False)))


def attribute_cases(log: DataFrame, column: str, values: list, keep: bool = True) -> DataFrame:
    return keep_cases(log, log.where(F.col(column).isin(values)), keep)


def numeric_events(log: DataFrame, column: str, low: float, high: float) -> DataFrame:
    return log.where(F.col(column).between(low, high))


def case_size(log: DataFrame, low: int, high: int) -> DataFrame:
    return log.withColumn("_n", F.count("*").over(whole_case())).where(F.col("_n").between(low, high)).drop("_n")


def case_performance(log: DataFrame, low_s: float, high_s: float) -> DataFrame:
    d = (F.max("us").over(whole_case()) - F.min("us").over(whole_case())) / 1e6
    return log.withColumn("_d", d).where(F.col("_d").between(low_s, high_s)).drop("_d")


def follows(log: DataFrame, a: str, b: str, keep: bool = True) -> DataFrame:
    found = log.select("case_id", "activity", F.lead("activity").over(case_order()).alias("n")).where((F.col("activity") == a) & (F.col("n") == b))
    return keep_cases(log, found, keep)


def eventually(log: DataFrame, a: str, b: str, keep: bool = True) -> DataFrame:
    at = lambda x, f: f(F.when(F.col("activity") == x, F.struct("us", "event_idx")))
    return keep_cases(log, log.groupBy("case_id").agg(at(a, F.min).alias("a"), at(b, F.max).alias("b")).where("a < b"), keep)


def path_performance(log: DataFrame, a: str, b: str, low_s: float, high_s: float) -> DataFrame:
    n = log.select("case_id", "activity", F.lead("activity").over(case_order()).alias("n"), ((F.lead("us").over(case_order()) - F.col("us")) / 1e6).alias("g"))
    return keep_cases(log, n.where((F.col("activity") == a) & (F.col("n") == b) & F.col("g").between(low_s, high_s)))


def time_events(log: DataFrame, low_us: int, high_us: int) -> DataFrame:
    return log.where(F.col("us").between(low_us, high_us))


def time_contained(log: DataFrame, low_us: int, high_us: int) -> DataFrame:
    return keep_cases(log, cases(log).where((F.col("start_us") >= low_us) & (F.col("end_us") <= high_us)))


def time_intersecting(log: DataFrame, low_us: int, high_us: int) -> DataFrame:
    """Strict bounds, as in the established semantics: spans that only touch a bound do not meet it."""
    s, e = F.col("start_us"), F.col("end_us")
    return keep_cases(log, cases(log).where(((s > low_us) & (s < high_us)) | ((e > low_us) & (e < high_us)) | ((s < low_us) & (e > high_us))))


def rework(log: DataFrame, activity: str, least: int = 2) -> DataFrame:
    return keep_cases(log, log.where(F.col("activity") == activity).groupBy("case_id").agg(F.count("*").alias("k")).where(F.col("k") >= least))


def prefix(log: DataFrame, activity: str) -> DataFrame:
    """Events of a case before its first `activity`."""
    first = F.min(F.when(F.col("activity") == activity, F.struct("us", "event_idx"))).over(whole_case())
    return log.withColumn("_f", first).where(F.struct("us", "event_idx") < F.col("_f")).drop("_f")


def suffix(log: DataFrame, activity: str) -> DataFrame:
    last = F.max(F.when(F.col("activity") == activity, F.struct("us", "event_idx"))).over(whole_case())
    return log.withColumn("_l", last).where(F.struct("us", "event_idx") > F.col("_l")).drop("_l")


def starts_with(log: DataFrame, activities: list[str]) -> DataFrame:
    return keep_cases(log, traces(log).where(F.slice("trace", 1, len(activities)) == F.array(*map(F.lit, activities))))


def four_eyes(log: DataFrame, a: str, b: str, keep: bool = False) -> DataFrame:
    """Cases in which both activities are there: kept (keep=True) if some a and the last b have one resource, or (False) the others."""
    last = log.where(F.col("activity") == b).groupBy("case_id").agg(F.max_by("resource", F.struct("us", "event_idx")).alias("rb"))
    same = log.where(F.col("activity") == a).join(last, "case_id").where(F.col("resource") == F.col("rb"))
    return keep_cases(log, same, keep)


def variants_top_k(log: DataFrame, k: int) -> DataFrame:
    t = traces(log)
    v = t.groupBy("trace").agg(F.count("*").alias("n")).orderBy(F.desc("n"), F.desc(F.concat_ws(",", "trace"))).limit(k)
    return keep_cases(log, t.join(v, "trace", "left_semi"))


def between(log: DataFrame, a: str, b: str) -> DataFrame:
    """Sub-cases from each a to the next b: a fold over the case's events, state = where a sub-case began."""
    rows = F.array_sort(F.collect_list(F.struct("us", "event_idx", "activity")))
    t = log.groupBy("case_id").agg(rows.alias("r"))
    zero = F.struct(F.lit(-1).alias("open"), F.array().cast("array<struct<i:int,j:int>>").alias("out"))

    def step(s, i):
        act = F.element_at("r", (i + 1).cast("int"))["activity"]
        done = (s["open"] >= 0) & (act == b)
        return F.struct(F.when(done, -1).when((s["open"] < 0) & (act == a), i).otherwise(s["open"]).alias("open"), F.when(done, F.concat(s["out"], F.array(F.struct(s["open"].alias("i"), i.alias("j"))))).otherwise(s["out"]).alias("out"))

    spans = t.select("case_id", F.aggregate(F.sequence(F.lit(0), F.size("r") - 1), zero, step)["out"].alias("s"))
    return spans.select("case_id", F.posexplode("s").alias("k", "s")).select("case_id", F.col("k").cast("long").alias("sub_case"), (F.col("s.j") - F.col("s.i") + 1).cast("long").alias("n_events"))


def collapse(log: DataFrame) -> DataFrame:
    """Runs of one activity in a case are one event, the first."""
    before: Column = F.lag("activity").over(case_order())
    return log.withColumn("_b", before).where("_b is null or _b <> activity").drop("_b")


def relative_occurrence(log: DataFrame, column: str, values: list, share: float) -> DataFrame:
    """Cases at least `share` of whose events have one of the values."""
    hit = F.avg(F.when(F.col(column).isin(values), 1.0).otherwise(0.0)).over(whole_case())
    return log.withColumn("_s", hit).where(F.col("_s") >= share).drop("_s")


def variants(log: DataFrame, admitted: list[list[str]], keep: bool = True) -> DataFrame:
    """Cases whose trace is one of the admitted variants."""
    found = traces(log).where(F.col("trace").isin([F.array(*map(F.lit, v)) for v in admitted]))
    return keep_cases(log, found, keep)


def variants_by_coverage(log: DataFrame, least: float = 0.0, most: float = 1.0) -> DataFrame:
    """Cases of the variants that hold a share of all cases between `least` and `most`."""
    t = traces(log)
    v = t.groupBy("trace").agg(F.count("*").alias("n"))
    total = v.agg(F.sum("n").alias("total"))
    some = v.join(F.broadcast(total)).where((F.col("n") >= least * F.col("total")) & (F.col("n") <= most * F.col("total")))
    return keep_cases(log, t.join(some, "trace", "left_semi"))


def one_case_per_variant(log: DataFrame) -> DataFrame:
    """The case of the smallest id of each variant."""
    return keep_cases(log, traces(log).groupBy("trace").agg(F.min("case_id").alias("case_id")))


def ends_with(log: DataFrame, suffixes: list[list[str]], keep: bool = True) -> DataFrame:
    """Cases whose trace ends with one of the suffixes."""
    ok = F.lit(False)
    for s in suffixes:
        long_enough = F.size("trace") >= len(s)
        ok = ok | (long_enough & (F.slice("trace", F.greatest(F.size("trace") - len(s) + 1, F.lit(1)), F.lit(len(s))) == F.array(*map(F.lit, s))))
    return keep_cases(log, traces(log).where(ok), keep)


def starting_in(log: DataFrame, low_us: int, high_us: int) -> DataFrame:
    return keep_cases(log, cases(log).where(F.col("start_us").between(low_us, high_us)))


def completing_in(log: DataFrame, low_us: int, high_us: int) -> DataFrame:
    return keep_cases(log, cases(log).where(F.col("end_us").between(low_us, high_us)))


def attribute_in(log: DataFrame, column: str, value, low_us: int, high_us: int) -> DataFrame:
    """Cases with an event of this value in the time span."""
    return keep_cases(log, log.where((F.col(column) == value) & F.col("us").between(low_us, high_us)))


def numeric_cases(log: DataFrame, column: str, low: float, high: float, keep: bool = True) -> DataFrame:
    """Cases with an event whose value lies between the bounds."""
    return keep_cases(log, log.where(F.col(column).between(low, high)), keep)


def frequent_values(log: DataFrame, column: str, least: int) -> DataFrame:
    """Events whose value stands in at least `least` events."""
    n = log.groupBy(column).agg(F.count("*").alias("n")).where(F.col("n") >= least)
    return log.join(n.select(column), column, "left_semi")


def top_values(log: DataFrame, column: str, k: int) -> DataFrame:
    """Events of the k most frequent values; ties go by value."""
    n = log.where(F.col(column).isNotNull()).groupBy(column).agg(F.count("*").alias("n")).orderBy(F.desc("n"), column).limit(k)
    return log.join(F.broadcast(n.select(column)), column, "left_semi")


def frequent_ends(log: DataFrame, least: int, last: bool = False) -> DataFrame:
    """Cases whose first (or last) activity is that of at least `least` cases."""
    pick = F.max_by if last else F.min_by
    end = log.groupBy("case_id").agg(pick("activity", F.struct("us", "event_idx")).alias("end"))
    often = end.groupBy("end").agg(F.count("*").alias("n")).where(F.col("n") >= least)
    return keep_cases(log, end.join(often, "end", "left_semi"))


def follows_any(log: DataFrame, pairs: list[tuple[str, str]], keep: bool = True) -> DataFrame:
    """Cases in which one of the pairs follows directly."""
    step = log.select("case_id", F.col("activity").alias("a"), F.lead("activity").over(case_order()).alias("b"))
    ok = F.lit(False)
    for a, b in pairs:
        ok = ok | ((F.col("a") == a) & (F.col("b") == b))
    return keep_cases(log, step.where(ok), keep)


def next_three(log: DataFrame, a: str, b: str, c: str, keep: bool = True) -> DataFrame:
    """Cases in which a, b and c follow one another directly."""
    step = log.select("case_id", "activity", F.lead("activity", 1).over(case_order()).alias("n1"), F.lead("activity", 2).over(case_order()).alias("n2"))
    return keep_cases(log, step.where((F.col("activity") == a) & (F.col("n1") == b) & (F.col("n2") == c)), keep)


def different_resources(log: DataFrame, activity: str, keep: bool = True) -> DataFrame:
    """Cases in which several resources do the activity."""
    found = log.where(F.col("activity") == activity).groupBy("case_id").agg(F.count_distinct("resource").alias("k")).where("k > 1")
    return keep_cases(log, found, keep)


def split_at(log: DataFrame, activity: str) -> DataFrame:
    """A new case begins at each occurrence of the activity: case_id is (case, number from 0)."""
    begun = F.count_if(F.col("activity") == activity).over(case_order())
    return log.withColumn("case_id", F.struct("case_id", begun.alias("part")))
