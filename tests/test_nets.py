"""Nets against the trees they come from, alignments against brute force, PNML by a round trip."""

import random
from itertools import product

import pytest

from eventloom.operators import nets, trees
from eventloom.sources import logs
from eventloom.sources.nets import read_dfg, read_pnml, read_ptml, write_dfg, write_pnml, write_ptml

TEXTS = ["'a'", "->( 'a', X( 'b', tau ), 'c' )", "->( 'a', +( 'b', 'c' ), 'd' )", "X( ->( 'a', 'b' ), +( 'c', 'd' ) )", "->( 'a', *( 'b', 'c' ) )"]


def common(x, y):
    """Length of the longest common subsequence."""
    row = [0] * (len(y) + 1)
    for a in x:
        new = [0]
        for j, b in enumerate(y):
            new.append(row[j] + 1 if a == b else max(new[j], row[j + 1]))
        row = new
    return row[-1]


@pytest.mark.parametrize("text", TEXTS)
def test_cost_is_least_over_the_language(text):
    tree = trees.parse(text)
    language = {tuple(trees.walk(tree, random.Random(i))) for i in range(3000)}
    net = nets.from_tree(tree)
    for n in range(4):
        for trace in product("abcx", repeat=n):
            cost, moves = nets.align_trace(list(trace), net)
            assert cost == min(len(trace) + len(w) - 2 * common(trace, w) for w in language)
            assert [e for e, _ in moves if e] == list(trace) and sum(e != m for e, m in moves) == cost
    assert all(nets.align_trace(list(w), net)[0] == 0 for w in language)


def test_reachable():
    graph = nets.reachable(nets.from_tree(trees.parse("+( 'a', 'b' )")))
    assert len(graph) == 6 and sorted(label for steps in graph.values() for label, _ in steps if label) == ["a", "a", "b", "b"]
    with pytest.raises(ValueError):
        nets.reachable({"transitions": [("a", (0,), (0, 1))], "initial": (0,), "final": (1,)}, most=50)


def test_alignments(spark):
    rows = [(c, a, i, i) for c, t in enumerate(("abc", "ac", "ab", "abc", "xx")) for i, a in enumerate(t)]
    log = spark.createDataFrame(rows, "case_id long, activity string, us long, event_idx long")
    got = nets.alignments(log, nets.from_tree(trees.parse("->( 'a', 'b', 'c' )")))
    by = {r.case_id: (r.cost, r.fitness, r.alignment) for r in got.collect()}
    assert by[0] == by[3] == (0, 1.0, "a|a b|b c|c") and by[1] == (1, 0.8, "a|a >>|b c|c") and by[2][:2] == (1, 0.8) and by[4][:2] == (5, 0.0)
    assert nets.alignment_fitness(got).collect()[0].cases == 5
    assert nets.alignments(log.where("case_id < 0"), nets.from_tree("a")).count() == 0
    with pytest.raises(ValueError):
        nets.alignments(log, {"transitions": [], "initial": (0,), "final": (1,)})


@pytest.mark.parametrize("text", TEXTS)
def test_pnml_round_trip(tmp_path, text):
    net = nets.from_tree(trees.parse(text))
    write_pnml(net, str(tmp_path / "n.pnml"))
    back = read_pnml(str(tmp_path / "n.pnml"))
    assert back == net


@pytest.mark.parametrize("text", ["tau", "*( 'a', tau )", *TEXTS])
def test_ptml_round_trip(tmp_path, text):
    write_ptml(trees.parse(text), str(tmp_path / "t.ptml"))
    assert trees.show(read_ptml(str(tmp_path / "t.ptml"))) == text


def test_ptml_of_three_children(tmp_path):
    loop = '<xorLoop id="l" name=""/><manualTask id="a" name="a"/><automaticTask id="b" name=""/><{} id="c" name="c"/>'
    edges = "".join(f'<parentsNode id="e{c}" sourceId="l" targetId="{c}"/>' for c in "abc")
    for kind, want in (("automaticTask", "*( 'a', tau )"), ("manualTask", "->( *( 'a', tau ), 'c' )")):
        (tmp_path / "t.ptml").write_text(f'<ptml><processTree id="t" name="" root="l">{loop.format(kind)}{edges}</processTree></ptml>')
        assert trees.show(read_ptml(str(tmp_path / "t.ptml"))) == want


def test_dfg_round_trip(tmp_path):
    graph = [("a", "b x", 3), ("b x", "b x", 1)], [("a", 2)], [("b x", 2)]
    write_dfg(*graph, str(tmp_path / "g.dfg"))
    assert read_dfg(str(tmp_path / "g.dfg")) == graph


def test_xes_round_trip(spark, tmp_path):
    rows = [("c\"1", "a<b", 0, 0, "r&1", None, 1.5, True), ("c\"1", "b", 1_000_001, 1, None, 2**60, None, None), ("2", "a\nb", 5, 0, "x", 7, float("nan"), False)]
    log = spark.createDataFrame(rows, "case_id string, activity string, us long, event_idx long, resource string, n long, cost double, done boolean")
    logs.write_xes(log, str(tmp_path / "x"))
    back = {(r.case_id, r.event_idx): r for r in logs.read_xes(spark, str(tmp_path / "x")).collect()}
    assert {k: (r.activity, r.us, r.resource) for k, r in back.items()} == {(r[0], r[3]): (r[1], r[2], r[4]) for r in rows}
    assert back["c\"1", 0].attributes["cost"] == "1.5" and back["c\"1", 1].attributes["n"] == str(2**60) and "cost" not in back["c\"1", 1].attributes
    assert back["2", 0].attributes["done"] == "false" and "cost" not in back["2", 0].attributes
