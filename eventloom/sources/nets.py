"""Petri nets as PNML files: places, transitions, arcs, initial and final markings."""

from __future__ import annotations

from collections import Counter
from xml.etree import ElementTree as ET


def _local(e) -> str:
    return e.tag.rsplit("}", 1)[-1]


def _text(e, *path: str) -> str | None:
    for name in path:
        e = next((c for c in e if _local(c) == name), None)
        if e is None:
            return None
    return e.text


def write_pnml(net: dict, path: str) -> None:
    """A silent transition has no name and the toolspecific activity `$invisible$`."""
    root = ET.Element("pnml")
    top = ET.SubElement(root, "net", id="net1", type="http://www.pnml.org/version-2009/grammar/pnmlcoremodel")
    page = ET.SubElement(top, "page", id="n0")
    initial = Counter(net["initial"])
    for p in sorted({p for _, b, a in net["transitions"] for p in (*b, *a)} | set(net["initial"]) | set(net["final"])):
        e = ET.SubElement(page, "place", id=f"p{p}")
        if initial[p]:
            ET.SubElement(ET.SubElement(e, "initialMarking"), "text").text = str(initial[p])
    arcs = []
    for i, (label, before, after) in enumerate(net["transitions"]):
        e = ET.SubElement(page, "transition", id=f"t{i}")
        if label is None:
            ET.SubElement(e, "toolspecific", tool="ProM", version="6.4", activity="$invisible$")
        else:
            ET.SubElement(ET.SubElement(e, "name"), "text").text = label
        arcs += [(f"p{p}", f"t{i}") for p in before] + [(f"t{i}", f"p{p}") for p in after]
    for i, (s, t) in enumerate(arcs):
        ET.SubElement(page, "arc", id=f"a{i}", source=s, target=t)
    marking = ET.SubElement(ET.SubElement(top, "finalmarkings"), "marking")
    for p, n in sorted(Counter(net["final"]).items()):
        ET.SubElement(ET.SubElement(marking, "place", idref=f"p{p}"), "text").text = str(n)
    ET.ElementTree(root).write(path, encoding="utf-8", xml_declaration=True)


def read_pnml(path: str) -> dict:
    """Places are numbered as the file has them; a transition without a name, or marked invisible, is silent. Arc weights count."""
    elements = list(ET.parse(path).getroot().iter())
    of = lambda kind: [e for e in elements if _local(e) == kind and "id" in e.attrib]
    number = {e.get("id"): i for i, e in enumerate(of("place"))}
    initial = [number[e.get("id")] for e in of("place") for _ in range(int(_text(e, "initialMarking", "text") or 0))]
    final = [number[e.get("idref")] for m in elements if _local(m) == "marking" for e in m if e.get("idref") in number for _ in range(int(_text(e, "text") or 0))]
    before, after = {}, {}
    for e in of("arc"):
        s, t, n = e.get("source"), e.get("target"), int(_text(e, "inscription", "text") or 1)
        if s in number:
            before.setdefault(t, []).extend([number[s]] * n)
        else:
            after.setdefault(s, []).extend([number[t]] * n)
    found = []
    for e in of("transition"):
        silent = any(_local(c) == "toolspecific" and c.get("activity") == "$invisible$" for c in e)
        found.append((None if silent else _text(e, "name", "text"), tuple(before.get(e.get("id"), ())), tuple(after.get(e.get("id"), ()))))
    return {"transitions": found, "initial": tuple(initial), "final": tuple(final)}


def write_ptml(tree, path: str) -> None:
    """A process tree as PTML: a node for each operator and leaf, and parents as edges."""
    kinds = {"->": "sequence", "X": "xor", "+": "and", "*": "xorLoop"}
    root = ET.Element("ptml")
    nodes, edges = [], []

    def add(node) -> str:
        name = f"n{len(nodes)}"
        if node is None:
            nodes.append(("automaticTask", name, ""))
        elif isinstance(node, str):
            nodes.append(("manualTask", name, node))
        else:
            nodes.append((kinds[node[0]], name, ""))
            edges.extend((name, add(c)) for c in node[1])
        return name

    top = ET.SubElement(root, "processTree", id="tree", name="tree", root=add(tree))
    for kind, name, label in nodes:
        ET.SubElement(top, kind, id=name, name=label)
    for i, (s, t) in enumerate(edges):
        ET.SubElement(top, "parentsNode", id=f"e{i}", sourceId=s, targetId=t)
    ET.ElementTree(root).write(path, encoding="utf-8", xml_declaration=True)


def read_ptml(path: str):
    """A loop of body, redo and exit, as other tools write it, keeps body and redo if the exit is silent; else the exit follows."""
    top = next(e for e in ET.parse(path).getroot().iter() if _local(e) == "processTree")
    kinds = {"sequence": "->", "xor": "X", "and": "+", "xorLoop": "*"}
    nodes = {e.get("id"): e for e in top if _local(e) != "parentsNode"}
    children: dict = {}
    for e in top:
        if _local(e) == "parentsNode":
            children.setdefault(e.get("sourceId"), []).append(e.get("targetId"))

    def build(name):
        kind = _local(nodes[name])
        if kind not in kinds:
            return None if kind == "automaticTask" else nodes[name].get("name")
        parts = [build(c) for c in children.get(name, [])]
        if kind == "xorLoop" and len(parts) == 3:
            loop = ("*", parts[:2])
            return loop if parts[2] is None else ("->", [loop, parts[2]])
        return kinds[kind], parts

    return build(top.get("root"))


def write_dfg(edges, starts, ends, path: str) -> None:
    """A directly-follows graph as text: the activities, starts and ends with counts, and edges by the activities' numbers.

    `edges` holds (source, target, n), `starts` and `ends` (activity, n); all are the size of the alphabet squared at most.
    """
    names = sorted({x for s, t, _ in edges for x in (s, t)} | {a for a, _ in (*starts, *ends)})
    at = {a: i for i, a in enumerate(names)}
    lines = [str(len(names)), *names]
    for side in (starts, ends):
        lines += [str(len(side)), *(f"{at[a]}x{n}" for a, n in sorted(side))]
    lines += [f"{at[s]}>{at[t]}x{n}" for s, t, n in sorted(edges)]
    with open(path, "w", encoding="utf-8") as f:
        f.write("\n".join(lines) + "\n")


def read_dfg(path: str) -> tuple[list, list, list]:
    """(edges, starts, ends) as `write_dfg` takes them."""
    with open(path, encoding="utf-8") as f:
        lines = iter(f.read().splitlines())
    names = [next(lines) for _ in range(int(next(lines)))]
    pair = lambda text: (names[int(text.split("x")[0])], int(text.split("x")[1]))
    starts = [pair(next(lines)) for _ in range(int(next(lines)))]
    ends = [pair(next(lines)) for _ in range(int(next(lines)))]
    edges = [(names[int(s)], *pair(t)) for s, t in (line.split(">") for line in lines if line)]
    return edges, starts, ends
