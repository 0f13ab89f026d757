"""Petri nets with silent transitions, made from process trees; optimal alignments of traces with them.

A net is {"transitions": [(label or None, places before, places after), …], "initial": places, "final": places}: places are
numbers, and a marking is a sorted tuple in which a place stands once for each of its tokens.
"""

from __future__ import annotations

import heapq
from itertools import count

from pyspark.sql import DataFrame, functions as F

from ..log import traces
from .trees import CHOICE, LOOP, SEQUENCE


def from_tree(tree) -> dict:
    """The net of a process tree: from one place with a token to another."""
    number, transitions = count(2), []

    def add(node, start, end):
        if node is None or isinstance(node, str):
            transitions.append((node, (start,), (end,)))
            return
        operator, children = node
        if operator == CHOICE:
            for c in children:
                add(c, start, end)
        elif operator == SEQUENCE:
            stops = [start, *(next(number) for _ in children[1:]), end]
            for c, s, e in zip(children, stops, stops[1:]):
                add(c, s, e)
        elif operator == LOOP:
            s, e = next(number), next(number)
            transitions.append((None, (start,), (s,)))
            add(children[0], s, e)
            for c in children[1:]:
                add(c, e, s)
            transitions.append((None, (e,), (end,)))
        else:
            pairs = [(next(number), next(number)) for _ in children]
            transitions.append((None, (start,), tuple(s for s, _ in pairs)))
            for c, (s, e) in zip(children, pairs):
                add(c, s, e)
            transitions.append((None, tuple(e for _, e in pairs), (end,)))

    add(tree, 0, 1)
    return {"transitions": transitions, "initial": (0,), "final": (1,)}


def fire(marking: tuple, before: tuple, after: tuple) -> tuple | None:
    """The marking after a transition, or None where it is not enabled."""
    left = list(marking)
    for p in before:
        if p not in left:
            return None
        left.remove(p)
    return tuple(sorted(left + list(after)))


def reachable(net: dict, most: int = 100_000) -> dict:
    """{marking: [(label, next marking)]} of all that can be reached; ValueError beyond `most` markings."""
    out, todo = {}, [tuple(sorted(net["initial"]))]
    while todo:
        m = todo.pop()
        if m in out:
            continue
        if len(out) >= most:
            raise ValueError(f"more than {most} markings")
        out[m] = [(label, n) for label, b, a in net["transitions"] if (n := fire(m, b, a)) is not None]
        todo += [n for _, n in out[m] if n not in out]
    return out


def align_trace(trace: list[str], net: dict) -> tuple[int, list[tuple]] | None:
    """(cost, moves) of a cheapest alignment, or None where the net can't end.

    A move is (event, label): both, an event alone (None for the label) or a label alone; the latter two cost 1 each.
    Silent transitions cost nothing and are no moves.
    """
    goal, start = (tuple(sorted(net["final"])), len(trace)), (tuple(sorted(net["initial"])), 0)
    order, back, done = count(), {start: (0, None, None)}, set()
    heap = [(0, 0, next(order), start)]
    while heap:
        cost, _, _, state = heapq.heappop(heap)
        if state in done:
            continue
        done.add(state)
        if state == goal:
            moves = []
            while back[state][1] is not None:
                _, state, move = back[state]
                if move != (None, None):
                    moves.append(move)
            return cost, moves[::-1]
        marking, i = state
        steps = [((marking, i + 1), (trace[i], None), 1)] if i < len(trace) else []
        for label, before, after in net["transitions"]:
            n = fire(marking, before, after)
            if n is None:
                continue
            steps.append(((n, i), (None, label), 0 if label is None else 1))
            if i < len(trace) and label == trace[i]:
                steps.append(((n, i + 1), (trace[i], label), 0))
        for to, move, price in steps:
            if to not in done and (to not in back or cost + price < back[to][0]):
                back[to] = (cost + price, state, move)
                heapq.heappush(heap, (cost + price, -to[1], next(order), to))
    return None


def alignments(log: DataFrame, net: dict) -> DataFrame:
    """(case_id, cost, fitness, alignment): each case's cheapest alignment, found once for each distinct variant.

    Fitness is 1 less the cost as a share of the worst: all events alone, and then the net's shortest run. An alignment's
    moves are separated by spaces, `>>` stands where a side does not move. ValueError if the net can't end.
    """
    empty = align_trace([], net)
    if empty is None:
        raise ValueError("the final marking can't be reached")
    t = traces(log)

    def find(batches):
        for b in batches:
            found = [align_trace(list(x), net) for x in b["trace"]]
            b["cost"] = [c for c, _ in found]
            b["alignment"] = [" ".join(f"{e or '>>'}|{m or '>>'}" for e, m in moves) for _, moves in found]
            yield b

    done = t.select("trace").distinct().mapInPandas(find, "trace array<string>, cost long, alignment string")
    worst = F.size("trace") + F.lit(empty[0])
    fitness = F.when(worst == 0, 1.0).otherwise(F.round(1 - F.col("cost") / worst, 6))
    return t.join(done, "trace").select("case_id", "cost", fitness.alias("fitness"), "alignment")


def alignment_fitness(aligned: DataFrame) -> DataFrame:
    """(cases, share_fit, mean_fitness) of all alignments."""
    return aligned.agg(F.count("*").alias("cases"), F.round(F.avg((F.col("cost") == 0).cast("double")), 6).alias("share_fit"), F.round(F.avg("fitness"), 4).alias("mean_fitness"))
