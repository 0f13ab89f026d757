"""Models discovered from aggregated relations, and replay of distinct variants on them.

What is aggregated in Spark (edges, variants) is the size of a model; the nets are found on the driver, and replay runs
once for each distinct variant, with the net broadcast, however many cases a variant has.
"""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import DataFrame, functions as F

from ..log import traces
from . import dfg, stats


def prefix_tree(log: DataFrame) -> DataFrame:
    """(prefix, depth, n): every prefix of a trace and the cases that begin with it."""
    v = traces(log).groupBy("trace").agg(F.count("*").alias("n"))
    p = v.select("n", "trace", F.explode(F.sequence(F.lit(1), F.size("trace"))).alias("depth"))
    by = p.groupBy(F.slice("trace", F.lit(1), F.col("depth")).alias("prefix"), F.col("depth").cast("long").alias("depth")).agg(F.sum("n").alias("n"))
    return by.select(F.concat_ws(",", "prefix").alias("prefix"), "depth", "n")


def variant_paths_duration(log: DataFrame) -> DataFrame:
    """(variant, step, source, target, n, mean_s): each step of each variant with its mean time."""
    rows = F.array_sort(F.collect_list(F.struct("us", "event_idx", "activity")))
    t = log.groupBy("case_id").agg(rows.alias("e")).select(F.transform("e", lambda x: x["activity"]).alias("trace"), F.transform("e", lambda x: x["us"]).alias("at"))
    steps = t.where(F.size("trace") > 1).select("trace", "at", F.explode(F.sequence(F.lit(1), F.size("trace") - 1)).alias("step"))
    gap = F.element_at("at", F.col("step") + 1) - F.element_at("at", F.col("step"))
    by = steps.groupBy("trace", "step").agg(F.count("*").alias("n"), (F.sum(gap).cast("double") / F.count("*") / 1e6).alias("mean_s"))
    return by.select(F.concat_ws(",", "trace").alias("variant"), F.col("step").cast("long").alias("step"), F.element_at("trace", F.col("step")).alias("source"), F.element_at("trace", F.col("step") + 1).alias("target"), "n", "mean_s")


def alpha_net(log: DataFrame) -> dict:
    """The net of the alpha algorithm: places as (activities before, activities after), and the ends.

    A place joins a set A with a set B if every a is followed by every b and never the other way, and neither
    the members of A nor those of B follow each other; only maximal places are kept.
    """
    edges = {(r["source"], r["target"]) for r in dfg.frequency(log).select("source", "target").collect()}  # alphabet squared at most
    causal = {(a, b) for a, b in edges if (b, a) not in edges}
    apart = lambda group: not any((x, y) in edges or (y, x) in edges for x, y in combinations(group, 2)) and not any((x, x) in edges for x in group)
    found = {(frozenset([a]), frozenset([b])) for a, b in causal if apart([a]) and apart([b])}
    grown = set(found)
    while grown:
        new = set()
        for a, b in grown:
            for x, y in found:
                if len(x) == len(y) == 1 and (x <= a) != (y <= b):
                    place = a | x, b | y
                    if place not in found and place not in new and apart(place[0]) and apart(place[1]) and all((s, t) in causal for s in place[0] for t in place[1]):
                        new.add(place)
        found |= new
        grown = new
    places = [p for p in found if not any(p != q and p[0] <= q[0] and p[1] <= q[1] for q in found)]
    ends = lambda last: sorted(r["activity"] for r in stats.endpoints(log, last).collect())
    return {"places": sorted((sorted(a), sorted(b)) for a, b in places), "start": ends(False), "end": ends(True)}


def alpha_places(log: DataFrame) -> DataFrame:
    """The alpha net as rows: (place, side, activity); the source and the sink are places with one side."""
    net = alpha_net(log)
    rows = [(",".join(a) + " > " + ",".join(b), side, x) for a, b in net["places"] for side, group in (("in", a), ("out", b)) for x in group]
    rows += [("source", "out", x) for x in net["start"]] + [("sink", "in", x) for x in net["end"]]
    return log.sparkSession.createDataFrame(rows, "place string, side string, activity string")


def replay_trace(trace: list[str], net: dict) -> tuple[int, int, int, int]:
    """(produced, consumed, missing, remaining) tokens of a trace played on a net; activities that the net lacks are skipped."""
    places = [*net["places"], ([], net["start"]), (net["end"], [])]
    marking = [0] * len(places)
    source, sink = len(places) - 2, len(places) - 1
    marking[source] = 1
    produced, consumed, missing = 1, 0, 0
    known = {x for a, b in places for x in (*a, *b)}
    for activity in trace:
        if activity not in known:
            continue
        for i, (_, after) in enumerate(places):
            if activity in after:
                consumed += 1
                if marking[i]:
                    marking[i] -= 1
                else:
                    missing += 1
        for i, (before, _) in enumerate(places):
            if activity in before:
                produced += 1
                marking[i] += 1
    consumed += 1
    if marking[sink]:
        marking[sink] -= 1
    else:
        missing += 1
    return produced, consumed, missing, sum(marking)


def replay(log: DataFrame, net: dict) -> DataFrame:
    """(case_id, produced, consumed, missing, remaining, fitness, is_fit) by token-based replay, once for each distinct variant."""
    t = traces(log)
    v = t.select("trace").distinct()

    def play(batches):
        for b in batches:
            b[["produced", "consumed", "missing", "remaining"]] = [replay_trace(list(x), net) for x in b["trace"]]
            yield b

    empty = "trace array<string>, produced long, consumed long, missing long, remaining long"
    done = v.mapInPandas(play, empty)
    fitness = 0.5 * (1 - F.col("missing") / F.col("consumed")) + 0.5 * (1 - F.col("remaining") / F.col("produced"))
    return t.join(done, "trace").select("case_id", "produced", "consumed", "missing", "remaining", F.round(fitness, 6).alias("fitness"), ((F.col("missing") == 0) & (F.col("remaining") == 0)).alias("is_fit"))


def replay_fitness(replayed: DataFrame) -> DataFrame:
    """Fitness of a log: the share of fitting cases, the mean of the cases' fitness, and that of all tokens together."""
    s = {c: F.sum(c) for c in ("missing", "consumed", "remaining", "produced")}
    whole = 0.5 * (1 - s["missing"] / s["consumed"]) + 0.5 * (1 - s["remaining"] / s["produced"])
    return replayed.agg(F.count("*").alias("cases"), F.round(F.avg(F.col("is_fit").cast("double")), 6).alias("share_fit"), F.round(F.avg("fitness"), 4).alias("mean_fitness"), F.round(whole, 6).alias("log_fitness"))


def footprints_fitness(log: DataFrame, model: DataFrame) -> DataFrame:
    """Edges of a log that a model's footprints (source, target, relation) allow, by occurrences."""
    ok = model.select("source", "target").unionByName(model.where("relation = '||'").select(F.col("target").alias("source"), F.col("source").alias("target"))).distinct().withColumn("ok", F.lit(1))
    f = dfg.frequency(log).join(ok, ["source", "target"], "left")
    return f.agg(F.count("*").alias("edges"), F.count("ok").alias("allowed"), F.round(F.sum(F.col("frequency") * F.coalesce("ok", F.lit(0))) / F.sum("frequency"), 6).alias("fitness"))
