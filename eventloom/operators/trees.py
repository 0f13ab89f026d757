"""Process trees: read and printed, mined from a directly-follows graph, and played out as a log.

A tree is an activity's name, None (a silent step), or (operator, children) with the operators below. What is mined
from is the graph that Spark has aggregated, the size of the alphabet squared, whatever the number of cases.
"""

from __future__ import annotations

import random
import re

from pyspark.sql import DataFrame, SparkSession

from . import dfg, stats

SEQUENCE, CHOICE, PARALLEL, LOOP = "->", "X", "+", "*"
TOKEN = re.compile(r"\s*(?:(->|X|\+|\*)\s*\(|('(?:[^'\\]|\\.)*')|(tau)|([,)]))")


def parse(text: str):
    """A tree from text like ->( 'a', X( 'b', tau ) )."""

    def node(at):
        m = TOKEN.match(text, at)
        if m is None or m[4]:
            raise ValueError(f"no process tree at {at}: {text[at:at + 20]!r}")
        if m[2]:
            return re.sub(r"\\(.)", r"\1", m[2][1:-1]), m.end()
        if m[3]:
            return None, m.end()
        children, at, operator = [], m.end(), m[1]
        while True:
            child, at = node(at)
            children.append(child)
            m = TOKEN.match(text, at)
            if m is None or not m[4]:
                raise ValueError(f"a comma or bracket is missing at {at}")
            at = m.end()
            if m[4] == ")":
                return (operator, children), at

    tree, end = node(0)
    if text[end:].strip():
        raise ValueError(f"text after the tree: {text[end:end + 20]!r}")
    return tree


def show(tree) -> str:
    """The text of a tree, which `parse` reads."""
    if tree is None:
        return "tau"
    if isinstance(tree, str):
        return "'" + re.sub(r"(['\\])", r"\\\1", tree) + "'"
    return f"{tree[0]}( {', '.join(map(show, tree[1]))} )"


def _groups(items, joined) -> list[set]:
    """Connected groups of items, joined by pairs."""
    group = {x: {x} for x in items}
    for a, b in joined:
        if group[a] is not group[b]:
            group[a] |= group[b]
            for x in group[b]:
                group[x] = group[a]
    return sorted({id(g): g for g in group.values()}.values(), key=min)


def _reach(acts, edges) -> dict:
    """What can be reached from each activity in one step or more."""
    out = {a: {t for s, t in edges if s == a} for a in acts}
    for k in acts:
        for a in acts:
            if k in out[a]:
                out[a] |= out[k]
    return out


def _sequence(acts, edges):
    """Parts in order, each reaching all later ones and none before."""
    reach = _reach(acts, edges)
    parts = _groups(acts, [(a, b) for a in acts for b in acts if a < b and (b in reach[a]) == (a in reach[b])])
    return sorted(parts, key=lambda p: (-len(set().union(*(reach[a] for a in p)) - p), min(p)))


def _parallel(acts, edges, starts, ends):
    """Parts whose members all follow each other both ways; a part without a start or an end joins another."""
    parts = _groups(acts, [(a, b) for a in acts for b in acts if a < b and not ((a, b) in edges and (b, a) in edges)])
    whole = [p for p in parts if p & starts and p & ends]
    if not whole:
        return [set(acts)]
    for p in parts:
        if p not in whole:
            whole[0] = whole[0] | p
    return whole


def _loop(acts, edges, starts, ends):
    """A body with all starts and ends, and parts that lead from every end back to every start."""
    body = starts | ends
    rest = acts - body
    parts = _groups(rest, [(a, b) for a, b in edges if a in rest and b in rest])
    redo = []
    for p in parts:
        entered = {t for s, t in edges if s in body and t in p}
        left = {s for s, t in edges if s in p and t in body}
        ok = all(s in ends for s, t in edges if s in body and t in p) and all(t in starts for s, t in edges if s in p and t in body)
        ok = ok and all((e, x) in edges for e in ends for x in entered) and all((x, s) in edges for s in starts for x in left)
        if ok and entered and left:
            redo.append(p)
        else:
            body = body | p
    return [body, *redo]


def mine(acts: set, edges: set, starts: set, ends: set):
    """The tree of a graph: choice, sequence, parallel and loop cuts in turn, and a flower where none cuts."""
    if not acts:
        return None
    if len(acts) == 1:
        a = next(iter(acts))
        return (LOOP, [a, None]) if (a, a) in edges else a
    inner = lambda p: {(s, t) for s, t in edges if s in p and t in p}
    own = lambda p: mine(p, inner(p), starts & p, ends & p)
    plain = {(s, t) for s, t in edges if s != t}
    parts = _groups(acts, plain)
    if len(parts) > 1:
        return CHOICE, [own(p) for p in parts]
    parts = _sequence(acts, plain)
    if len(parts) > 1:
        children = []
        for i, p in enumerate(parts):
            before, after = set().union(*parts[:i]), set().union(*parts[i + 1 :])
            entry = (starts & p) | {t for s, t in edges if s in before and t in p}
            leave = (ends & p) | {s for s, t in edges if s in p and t in after}
            passed = bool(starts & after or ends & before) or any(s in before and t in after for s, t in edges)
            child = mine(p, inner(p), entry, leave)
            children.append((CHOICE, [child, None]) if passed else child)
        return SEQUENCE, children
    parts = _parallel(acts, plain, starts, ends)
    if len(parts) > 1:
        return PARALLEL, [own(p) for p in parts]
    body, *redo = _loop(acts, plain, starts, ends)
    if redo:
        back = [mine(p, inner(p), {t for s, t in edges if s in ends and t in p}, {s for s, t in edges if s in p and t in starts}) for p in redo]
        # an end that leads straight to a start repeats the body without a redo part
        if any((e, s) in edges for e in ends for s in starts):
            back.append(None)
        kept = {(s, t) for s, t in inner(body) if not (s in ends and t in starts)}
        return LOOP, [mine(body, kept, starts, ends), back[0] if len(back) == 1 else (CHOICE, back)]
    kept = {(s, t) for s, t in edges if not (s in ends and t in starts)}
    if kept != edges:
        return LOOP, [mine(acts, kept, starts, ends), None]
    return LOOP, [None, (CHOICE, sorted(acts))]


def inductive(log: DataFrame, noise: float = 0.0):
    """The process tree of a log's directly-follows graph; edges under `noise` of the commonest from the same activity don't count."""
    rows = [tuple(r) for r in dfg.frequency(log).select("source", "target", "frequency").collect()]  # alphabet squared at most
    most: dict = {}
    for s, _, n in rows:
        most[s] = max(most.get(s, 0), n)
    edges = {(s, t) for s, t, n in rows if n >= noise * most[s]}
    starts, ends = ({r["activity"] for r in stats.endpoints(log, last).collect()} for last in (False, True))
    return mine(starts | ends | {x for s, t, _ in rows for x in (s, t)}, edges, starts, ends)


def inductive_tree(log: DataFrame, noise: float = 0.0) -> DataFrame:
    """One row (tree), as text; of an empty log it is tau."""
    return log.sparkSession.createDataFrame([(show(inductive(log, noise)),)], "tree string")


def walk(tree, rng: random.Random, again: float = 0.5) -> list[str]:
    """A trace that the tree allows; each loop goes on with the chance `again`."""
    if tree is None:
        return []
    if isinstance(tree, str):
        return [tree]
    operator, children = tree
    if operator == CHOICE:
        return walk(rng.choice(children), rng, again)
    if operator == SEQUENCE:
        return [a for c in children for a in walk(c, rng, again)]
    if operator == PARALLEL:
        runs = [walk(c, rng, again)[::-1] for c in children]
        order = [i for i, r in enumerate(runs) for _ in r]
        rng.shuffle(order)
        return [runs[i].pop() for i in order]
    out = walk(children[0], rng, again)
    while rng.random() < again:
        out += walk(rng.choice(children[1:]), rng, again) + walk(children[0], rng, again)
    return out


def playout(spark: SparkSession, tree, cases: int, seed: int = 0, first_us: int = 10_000_000_000_000, step_us: int = 1_000_000) -> DataFrame:
    """A log of so many cases played from a tree. A case's trace hangs on seed and case alone, so that a lost task gives the same rows again."""

    def play(batches):
        import pandas as pd

        for b in batches:
            for at in range(0, len(b), 1000):
                ids = b["id"].iloc[at : at + 1000]
                rows = [(i, a, first_us + k * step_us, k) for i in ids for k, a in enumerate(walk(tree, random.Random(f"{seed}:{i}")))]
                yield pd.DataFrame(rows, columns=["case_id", "activity", "us", "event_idx"]).astype({"case_id": "int64", "us": "int64", "event_idx": "int64"})

    return spark.range(cases).mapInPandas(play, "case_id long, activity string, us long, event_idx long")
