"""Log skeleton, declarative constraints, temporal profile, and prediction targets."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from ..log import case_order, whole_case


def _per_case(log: DataFrame) -> DataFrame:
    k = F.struct("us", "event_idx")
    return log.groupBy("case_id", "activity").agg(F.min(k).alias("first"), F.max(k).alias("last"), F.count("*").alias("n"))


def _pairs(log: DataFrame) -> DataFrame:
    """Both activities' first, last and count for each case that has a; b's are null where it is missing. Work: cases x alphabet squared."""
    p = _per_case(log)
    acts = [r[0] for r in log.select("activity").distinct().orderBy("activity").collect()]
    a = p.select("case_id", F.col("activity").alias("a"), F.col("first").alias("fa"), F.col("last").alias("la"), F.col("n").alias("na")).withColumn("b", F.explode(F.array(*map(F.lit, acts)))).where("a <> b")
    b = p.select("case_id", F.col("activity").alias("b"), F.col("first").alias("fb"), F.col("last").alias("lb"), F.col("n").alias("nb"))
    return a.join(b, ["case_id", "b"], "left")


def skeleton(log: DataFrame) -> DataFrame:
    """For each pair: in how many of a's cases the relations of a log skeleton hold."""
    t = lambda c: F.count_if(F.expr(c)).alias
    return _pairs(log).groupBy("a", "b").agg(F.count("*").alias("cases"), t("na = nb")("equivalence"), t("la < lb")("always_after"), t("fb < fa")("always_before"), t("nb is null")("never_together"))


def declare(log: DataFrame) -> DataFrame:
    """Support of response, precedence, succession and co-existence for each pair: cases that satisfy them among those with a."""
    t = lambda c: F.count_if(F.expr(c)).alias
    return _pairs(log).groupBy("a", "b").agg(t("la < lb")("response"), t("fa < fb")("precedence"), t("la < lb and fa < fb")("succession"), t("nb is not null")("coexistence"))


def temporal_profile(log: DataFrame) -> DataFrame:
    """Mean and deviation, in seconds, of the time from an activity to every later event of its case, by activities.

    Pairs of events are never made: each event meets the running count, sum and sum of squares of every
    activity's earlier times in its case, so work is events x alphabet. Times count from the case's start and sums are
    exact. A pair that occurs once has deviation 0.
    """
    acts = [r[0] for r in log.select("activity").distinct().orderBy("activity").collect()]  # a log's alphabet: model-sized
    t = log.select("case_id", "activity", "us", "event_idx", (F.col("us") - F.min("us").over(whole_case())).cast("decimal(18,0)").alias("t"))
    grid = t.withColumn("a", F.explode(F.array(*map(F.lit, acts))))
    w = Window.partitionBy("case_id", "a").orderBy("us", "event_idx").rowsBetween(Window.unboundedPreceding, -1)
    own = lambda c: F.coalesce(F.sum(F.when(F.col("activity") == F.col("a"), c)).over(w), F.lit(0).cast("decimal(18,0)"))
    now = F.col("t")
    seen = grid.select("a", F.col("activity").alias("b"), "t", own(F.lit(1).cast("decimal(9,0)")).alias("k"), own(now).alias("s"), own((now * now).cast("decimal(30,0)")).alias("q")).where("k > 0")
    d = lambda c: c.cast("decimal(38,0)")
    sums = seen.groupBy("a", "b").agg(F.sum("k").alias("n"), F.sum(d(F.col("k") * now) - d(F.col("s"))).alias("s"), F.sum(d(F.col("k") * d(now * now)) - 2 * d(d(F.col("s")) * now) + d(F.col("q"))).alias("q"))
    n, s, q = (F.col(c).cast("double") for c in ("n", "s", "q"))
    variance = F.when(n > 1, F.greatest((q - s * s / n) / (n - 1), F.lit(0.0))).otherwise(0.0)
    return sums.select("a", "b", (s / n / 1e6).alias("mean_s"), F.round(F.sqrt(variance) / 1e6, 3).alias("std_s"))


def temporal_deviations(log: DataFrame, profile: DataFrame, zeta: float = 2.0) -> DataFrame:
    """How many pairs of an event and a later one of its case lie further from the profile's mean than zeta deviations.

    Pairs are never made. A pair of activities has a least gap that is too long and a greatest that is too short, so
    each event asks how many earlier events of the other activity lie beyond these: a running count over its
    case's events and questions, sorted by time. Work is events x alphabet.
    """
    most, mean = F.lit(zeta) * F.col("std_s"), F.col("mean_s")
    # the gaps are whole microseconds: those around each bound are judged by the test itself
    tried = lambda bound, test: F.filter(F.sequence(*(F.floor(bound * 1e6) + i for i in (-16, 16))), test)
    long = F.array_min(tried(mean + most, lambda g: g / 1e6 - mean > most))
    short = F.array_max(tried(mean - most, lambda g: g / 1e6 - mean < -most))
    bounds = profile.select("a", "b", F.when(most < 0, 0).otherwise(F.greatest(long, F.lit(0))).alias("long"), F.when(most < 0, -1).otherwise(short).alias("short")).where("long is not null")
    asked = bounds.groupBy(F.col("b").alias("activity")).agg(F.collect_list(F.struct("a", "long", "short")).alias("asked"))
    pos = F.row_number().over(Window.partitionBy("case_id").orderBy("us", "event_idx", "activity")).cast("long")
    row = lambda a, at, pos, counts: F.struct(a.alias("a"), at.alias("at"), pos.alias("pos"), F.lit(counts).alias("counts"))
    us, own, end = F.col("us"), F.col("pos"), F.lit(2**63 - 1)

    def questions(x):
        """Earlier events of a: those as far as `long`, and those before this one without those beyond `short`."""
        far = row(x["a"], us - x["long"], F.when(x["long"] > 0, end).otherwise(own), 1)
        near = F.array(row(x["a"], us, own, 1), row(x["a"], us - x["short"] - 1, end, -1))
        return F.when(x["short"] >= 0, F.concat(F.array(far), near)).otherwise(F.array(far))

    event = row(F.col("activity"), us, own, 0)
    rows = log.select("case_id", "activity", "us", pos.alias("pos")).join(F.broadcast(asked), "activity", "left")
    each = F.concat(F.array(event), F.coalesce(F.flatten(F.transform("asked", questions)), F.slice(F.array(event), 1, 0)))
    rows = rows.select("case_id", F.col("activity").alias("b"), F.explode(each).alias("x")).select("case_id", "b", "x.*")
    w = Window.partitionBy("case_id", "a").orderBy("at", "pos", F.col("counts") == 0).rowsBetween(Window.unboundedPreceding, 0)
    seen = rows.select("a", "b", "counts", F.count_if(F.col("counts") == 0).over(w).alias("n")).where("counts <> 0")
    return seen.groupBy("a", "b").agg(F.sum(F.col("counts") * F.col("n")).alias("deviations")).where("deviations > 0")


def targets(log: DataFrame) -> DataFrame:
    """Next activity, seconds to it, and remaining seconds for each event."""
    return log.select("case_id", "event_idx", "activity", F.lead("activity").over(case_order()).alias("next_activity"), F.round((F.lead("us").over(case_order()) - F.col("us")) / 1e6, 6).alias("next_s"), F.round((F.max("us").over(whole_case()) - F.col("us")) / 1e6, 6).alias("remaining_s"))


def prefix_states(log: DataFrame, k: int = 2) -> DataFrame:
    """Transition system: states are the last k activities; (state, activity, next state, n)."""
    w = Window.partitionBy("case_id").orderBy("us", "event_idx").rowsBetween(-k, -1)
    s = log.select("activity", F.concat_ws(",", F.collect_list("activity").over(w)).alias("state"), F.concat_ws(",", F.collect_list("activity").over(w.rowsBetween(-k + 1, 0))).alias("next_state"))
    return s.groupBy("state", "activity", "next_state").agg(F.count("*").alias("n"))


def features(log: DataFrame) -> DataFrame:
    """Case features: a count for each activity (the alphabet is the pivot's fixed list), events, duration, mean cost."""
    acts = [r[0] for r in log.select("activity").distinct().orderBy("activity").collect()]
    return log.groupBy("case_id").agg(*(F.count_if(F.col("activity") == a).alias(f"n_{a}") for a in acts), F.count("*").alias("n_events"), F.round((F.max("us") - F.min("us")) / 1e6, 4).alias("duration_s"), F.round(F.avg("cost"), 6).alias("mean_cost"))


def declare_unary(log: DataFrame) -> DataFrame:
    """Cases in which an activity occurs, is missing, occurs once, and comes first."""
    p = _per_case(log)
    start = log.groupBy("case_id").agg(F.min(F.struct("us", "event_idx")).alias("start"))
    total = log.agg(F.count_distinct("case_id").alias("total"))
    per = p.join(start, "case_id").groupBy("activity").agg(F.count("*").alias("existence"), F.count_if(F.col("n") == 1).alias("exactly_one"), F.count_if(F.col("first") == F.col("start")).alias("init"))
    return per.join(F.broadcast(total)).select("activity", "existence", (F.col("total") - F.col("existence")).alias("absence"), "exactly_one", "init")


def declare_alternate(log: DataFrame) -> DataFrame:
    """Support of alternate response, precedence and succession: the plain template, and equal counts."""
    t = lambda c: F.count_if(F.expr(c)).alias
    return _pairs(log).groupBy("a", "b").agg(t("na = nb and la < lb")("alternate_response"), t("na = nb and fa < fb")("alternate_precedence"), t("na = nb and la < lb and fa < fb")("alternate_succession"))


def chains(log: DataFrame) -> DataFrame:
    """For each pair: a's cases, those where b directly follows every a, and those where also every b directly follows an a (the chain templates)."""
    step = log.select("case_id", F.col("activity").alias("a"), F.lead("activity").over(case_order()).alias("b"))
    d = step.where("a <> b").groupBy("case_id", "a", "b").agg(F.count("*").alias("d"))
    t = lambda c: F.count_if(F.expr(c)).alias
    return _pairs(log).join(d, ["case_id", "a", "b"], "left").groupBy("a", "b").agg(F.count("*").alias("cases"), t("d = na")("directly_follows"), t("d = na and d = nb")("chain"))


def occurrences(log: DataFrame) -> DataFrame:
    """(activity, n, cases): in how many cases an activity occurs n times, 0 included; n is below the longest case's length."""
    per = log.groupBy("case_id", "activity").agg(F.count("*").alias("n")).groupBy("activity", "n").agg(F.count("*").alias("cases"))
    total = log.agg(F.count_distinct("case_id").alias("total"))
    none = per.groupBy("activity").agg(F.sum("cases").alias("c")).join(F.broadcast(total)).select("activity", F.lit(0).cast("long").alias("n"), (F.col("total") - F.col("c")).alias("cases"))
    return per.unionByName(none.where("cases > 0"))


#: What a pair of a case must satisfy, by the columns of `_pairs`.
RULES = {"equivalence": "na = nb", "always_after": "la < lb", "always_before": "fb < fa", "never_together": "nb is null"}


def rules(log: DataFrame, share: float = 1.0) -> DataFrame:
    """(a, b, rule): the skeleton relations that hold in at least a share of a's cases."""
    held = F.array(*(F.struct(F.lit(r).alias("rule"), F.count_if(F.expr(e)).alias("held")) for r, e in RULES.items()))
    by = _pairs(log).groupBy("a", "b").agg(F.count("*").alias("cases"), held.alias("x"))
    return by.select("a", "b", "cases", F.explode("x").alias("x")).where(F.col("x.held") >= share * F.col("cases")).select("a", "b", "x.rule")


def rule_violations(log: DataFrame, model: DataFrame) -> DataFrame:
    """(case_id, checked, violated): a model's rules that each case meets with their first activity, and those it breaks.

    The model, as `rules` gives it, has at most four rows for each pair of activities; an activity of the log that no rule
    names is not checked, and one that is named but missing from the log is known to be missing in all its cases.
    """
    one = model.groupBy("a", "b").agg(F.collect_set("rule").alias("rules"))
    p = _per_case(log)
    a = p.select("case_id", F.col("activity").alias("a"), F.col("first").alias("fa"), F.col("last").alias("la"), F.col("n").alias("na")).join(one, "a")
    b = p.select("case_id", F.col("activity").alias("b"), F.col("first").alias("fb"), F.col("last").alias("lb"), F.col("n").alias("nb"))
    broken = sum((F.when(F.array_contains("rules", r) & ~F.coalesce(F.expr(e), F.lit(False)), 1).otherwise(0) for r, e in RULES.items()), F.lit(0))
    by = a.join(b, ["case_id", "b"], "left").groupBy("case_id").agg(F.sum(F.size("rules")).alias("checked"), F.sum(broken).alias("violated"))
    return log.select("case_id").distinct().join(by, "case_id", "left").na.fill(0, ["checked", "violated"])


def declare_negative(log: DataFrame) -> DataFrame:
    """For each pair, those of a's cases that the negative templates allow: no b, no succession, no chain succession."""
    c = chains(log).select("a", "b", (F.col("cases") - F.col("chain")).alias("nonchainsuccession"))
    t = lambda e: F.count_if(~F.coalesce(F.expr(e), F.lit(False))).alias
    return _pairs(log).groupBy("a", "b").agg(t("nb is not null")("noncoexistence"), t("la < lb and fa < fb")("nonsuccession")).join(c, ["a", "b"])
