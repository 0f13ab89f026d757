"""Relations, nets and replay against literal logs."""

import math
import random
from collections import Counter

import pytest

from eventloom.operators import dfg, discovery, filters, org, relations, stats

HOUR = 3_600_000_000


@pytest.fixture(scope="module")
def make(spark):
    def log(*traces, resources=None):
        rows = [(c, a, i * HOUR, i, (resources or {}).get(a, f"r{i % 2}"), 1.0) for c, t in enumerate(traces) for i, a in enumerate(t)]
        return spark.createDataFrame(rows, "case_id long, activity string, us long, event_idx long, resource string, cost double")

    return log


def table(df, *keys):
    return {tuple(r[k] for k in keys): r for r in df.collect()}


def test_temporal_profile_takes_all_later_events(make):
    got = table(relations.temporal_profile(make("aabc", "ac")), "a", "b")
    assert set(got) == {("a", "a"), ("a", "b"), ("a", "c"), ("b", "c")}
    assert math.isclose(got["a", "c"]["mean_s"], (3 + 2 + 1) / 3 * 3600) and math.isclose(got["a", "c"]["std_s"], 3600)
    assert got["b", "c"]["mean_s"] == 3600 and got["b", "c"]["std_s"] == 0


def test_temporal_deviations(spark, make):
    profile = spark.createDataFrame([("a", "b", 3600.0, 100.0)], "a string, b string, mean_s double, std_s double")
    got = relations.temporal_deviations(make("ab", "acb", "acbb"), profile, 2).collect()
    assert [(r.a, r.b, r.deviations) for r in got] == [("a", "b", 3)]


def test_temporal_deviations_makes_no_pairs(spark, make):
    """Near and far gaps of any zeta, ties and negative means as by brute force, without a row for each pair."""
    rng = random.Random(5)
    rows = [(c, rng.choice("abc"), rng.randrange(400) * 250_000, rng.randrange(9), "r", 1.0) for c in range(4) for _ in range(80)]
    log = spark.createDataFrame(rows, make("a").schema)
    means = [("a", "b", 40.0, 9.25), ("a", "a", 30.25, 0.0), ("b", "c", -1.0, 0.5), ("c", "b", 0.0, 0.0), ("c", "c", 20.0, 1000.0)]
    for zeta in (0.0, 1.0, 2.0):
        want = Counter()
        for c in range(4):
            case = sorted((us, i, a) for k, a, us, i, *_ in rows if k == c)
            for a, b, mean, std in means:
                want[a, b] += sum(abs((y[0] - x[0]) / 1e6 - mean) > zeta * std for n, x in enumerate(case) for y in case[n + 1 :] if (x[2], y[2]) == (a, b))
        got = relations.temporal_deviations(log, spark.createDataFrame(means, "a string, b string, mean_s double, std_s double"), zeta)
        assert {(r.a, r.b): r.deviations for r in got.collect()} == {k: n for k, n in want.items() if n}
    one = spark.range(20_000).selectExpr("0L as case_id", "'a' as activity", "id * 1000000 as us", "id as event_idx")  # 200 million pairs
    got = relations.temporal_deviations(one, spark.createDataFrame([("a", "a", 10_000.0, 1000.0)], "a string, b string, mean_s double, std_s double"))
    assert got.collect()[0].deviations == sum(20_000 - g for g in range(1, 20_000) if abs(g - 10_000) > 2000)
    assert "posexplode" not in got._jdf.queryExecution().toString()  # no row for each pair


def test_causal_measure_is_given_both_ways_and_loops_have_none(make):
    got = {k: r["dependency"] for k, r in table(dfg.dependency(make("ab", "ab", "ba", "aa", "ac")), "source", "target").items()}
    assert got == {("a", "b"): 0.25, ("b", "a"): -0.25, ("a", "a"): 0.0, ("a", "c"): 0.5, ("c", "a"): -0.5}
    assert table(dfg.heuristics_dependency(make("aa")), "source", "target")["a", "a"]["dependency"] == 0.5


def test_noise_is_judged_by_the_weaker_end(make):
    got = dfg.noise_filtered(make(*["ab"] * 10, "ac", "abb"), 0.2)
    assert set(table(got, "source", "target")) == {("a", "b"), ("a", "c")}  # b-b: 1 of 11


def test_distributions_have_values_without_events(make):
    got = {r.hour: r.n for r in stats.distribution(make("ab"), "hour").collect()}
    assert got == {h: int(h < 2) for h in range(24)}
    assert stats.distribution(make("ab"), "month").count() == 12 and stats.distribution(make("ab"), "year").collect()[0].year == 1970


def test_one_case_and_even_resources_do_not_fail(make):
    assert stats.arrival_average(make("ab")).collect()[0].average_s is None
    got = org.similar_activities(make("ab", "ab", resources={"a": "x", "b": "y"})).collect()
    assert len(got) == 1
    even = make("ab", "ba")  # r0 and r1 do a and b once each
    assert org.similar_activities(even).collect()[0].similarity is None


def test_gaps_do_not_depend_on_order(make):
    log = make("abab", "ab", "aab")
    want = sorted(dfg.performance(log).collect())
    for k in (1, 3, 7):
        assert sorted(dfg.performance(log.repartition(k)).collect()) == want


def test_variants_keep_commas_apart(spark):
    rows = [(1, "a,b", 1, 1), (2, "a", 1, 1), (2, "b", 2, 2)]
    log = spark.createDataFrame(rows, "case_id long, activity string, us long, event_idx long")
    assert [r.n for r in stats.variant_durations(log).collect()] == [1, 1]
    assert {r.case_id for r in filters.variants(log, [["a", "b"]]).collect()} == {2}


def test_alpha_net_and_replay(make):
    """The textbook log: a, then b and c in either order or e, then d."""
    log = make("abcd", "acbd", "aed")
    net = discovery.alpha_net(log)
    assert net == {"places": [(["a"], ["b", "e"]), (["a"], ["c", "e"]), (["b", "e"], ["d"]), (["c", "e"], ["d"])], "start": ["a"], "end": ["d"]}
    assert discovery.alpha_places(log).count() == 14
    got = table(discovery.replay(make("abcd", "aed", "abd", "xabcd"), net), "case_id")
    assert [got[i,].is_fit for i in range(4)] == [True, True, False, True]
    r = got[2,]  # c is left out: its token remains, and d misses one
    assert (r.produced, r.consumed, r.missing, r.remaining) == (5, 5, 1, 1) and r.fitness == 0.8
    whole = discovery.replay_fitness(discovery.replay(log, net)).collect()[0]
    assert (whole.cases, whole.share_fit, whole.log_fitness) == (3, 1.0, 1.0)
