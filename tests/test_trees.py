"""Process trees: text, discovery on literal logs, and playout; batches and artificial events on literal logs."""

import random

import pytest
from hypothesis import given, settings, strategies as st

from eventloom.operators import columns, dfg, relations, timing, trees

NAMES = st.sampled_from(["a", "b c", "it's", "back\\slash", "(x)", "tau", "'"])
TREES = st.recursive(st.one_of(st.none(), NAMES), lambda c: st.tuples(st.sampled_from(["->", "X", "+", "*"]), st.lists(c, min_size=2, max_size=3)), max_leaves=8)


def mined(*traces):
    edges = {p for t in traces for p in zip(t, t[1:])}
    return trees.show(trees.mine({a for t in traces for a in t}, edges, {t[0] for t in traces}, {t[-1] for t in traces}))


@settings(max_examples=200, deadline=None)
@given(TREES)
def test_text_round_trip(tree):
    assert trees.parse(trees.show(tree)) == tree


@pytest.mark.parametrize("text", ["", "->(", "->( 'a' 'b' )", "'a' 'b'", "X)"])
def test_no_tree(text):
    with pytest.raises(ValueError):
        trees.parse(text)


def test_cuts():
    assert mined("abc") == "->( 'a', 'b', 'c' )"
    assert mined("ab", "cd") == "X( ->( 'a', 'b' ), ->( 'c', 'd' ) )"
    assert mined("abcd", "acbd") == "->( 'a', +( 'b', 'c' ), 'd' )"
    assert mined("abd", "acd") == "->( 'a', X( 'b', 'c' ), 'd' )"
    assert mined("abc", "ac") == "->( 'a', X( 'b', tau ), 'c' )"
    assert mined("ab", "abcab") == "*( ->( 'a', 'b' ), 'c' )"
    assert mined("ab", "abab") == "*( ->( 'a', 'b' ), tau )"
    assert mined("a", "aa") == "*( 'a', tau )"
    assert mined("abca", "bcab", "cabc") == "*( X( 'a', 'b', 'c' ), tau )"


@pytest.mark.parametrize("text", ["->( 'a', X( 'b', 'c' ), +( 'd', 'e' ) )", "->( 'a', *( ->( 'b', 'c' ), 'd' ), 'e' )", "+( ->( 'a', 'b' ), 'c' )"])
def test_mined_again_from_its_playout(spark, text):
    log = trees.playout(spark, trees.parse(text), 300, seed=1)
    assert log.columns == ["case_id", "activity", "us", "event_idx"] and log.select("case_id").distinct().count() == 300
    assert sorted(log.collect()) == sorted(trees.playout(spark, trees.parse(text), 300, seed=1).repartition(3).collect())
    again = trees.inductive(log)
    graph = lambda tree: {p for i in range(2000) for t in [trees.walk(tree, random.Random(i))] for p in zip(t, t[1:])}
    assert graph(again) == graph(trees.parse(text))


def test_empty_log(spark):
    empty = spark.createDataFrame([], "case_id long, activity string, us long, event_idx long, resource string, end_us long")
    assert trees.inductive_tree(empty).collect()[0].tree == "tau"
    for df in (columns.artificial_ends(empty), columns.alphabet(empty), columns.lifted(empty, "resource"), columns.lifecycle(empty), timing.batches(empty), relations.occurrences(empty)):
        assert df.count() == 0


def test_artificial_ends(spark):
    log = spark.createDataFrame([(1, "a", 5000, 0, "r"), (1, "b", 5000, 1, None)], "case_id long, activity string, us long, event_idx long, resource string")
    got = {(r.source, r.target) for r in dfg.frequency(columns.artificial_ends(log)).collect()}
    assert got == {("▶", "a"), ("a", "b"), ("b", "■")}


def test_batches(spark):
    s, day = 1_000_000, 86_400_000_000
    times = {
        "simultaneous": [(0, 5), (0, 5)],
        "same start": [(0, 5), (0, 6)],
        "same end": [(0, 5), (1, 5)],
        "sequential": [(0, 5), (5, 7), (7, 9)],
        "concurrent": [(0, 5), (4, 7)],
        # over midnight, with a long interval that is open all the time
        "concurrent ": [(86_390, 200_000), (90_000, 90_001), (190_000, 190_001)],
        "none": [(0, 5), (2000, 2005)],
    }
    rows = [(i, k, "r", a * s, z * s) for k, v in times.items() for i, (a, z) in enumerate(v)]
    log = spark.createDataFrame(rows + [(9, "none", None, 0, day)], "case_id long, activity string, resource string, us long, end_us long")
    got = {r.activity: (r.kind, r.size) for r in timing.batches(log).collect()}
    assert got == {k: (k.strip(), len(v)) for k, v in times.items() if k != "none"}


def test_rule_violations(spark):
    make = lambda *ts: spark.createDataFrame([(c, a, i, i) for c, t in enumerate(ts) for i, a in enumerate(t)], "case_id long, activity string, us long, event_idx long")
    model = relations.rules(make("abc", "abc"))
    got = {r.case_id: (r.checked, r.violated) for r in relations.rule_violations(make("abc", "ac", "cba", "x"), model).collect()}
    # six equivalences, a>b, a>c, b>c after, b<a, c<a, c<b before
    assert got == {0: (12, 0), 1: (8, 4), 2: (12, 6), 3: (0, 0)}
