"""Process graphs: parsing, checks, order, and suggestions for misspelt names."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

from ..errors import GraphError

MAX_DEPTH = 64


def distance(a: str, b: str) -> int:
    """Levenshtein distance."""
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def suggestions(name: str, known: Iterable[str]) -> list[str]:
    """Up to three names within max(2, a third of the length) edits, nearest first, then by name."""
    near = sorted((d, k) for k in set(known) if (d := distance(name, k)) <= max(2, len(name) // 3))
    return [k for _, k in near[:3]]


def suggest(name: str, known: Iterable[str]) -> str:
    found = suggestions(name, known)
    return f"; did you mean {', '.join(found)}?" if found else ""


@dataclass(frozen=True)
class Node:
    process: str
    arguments: dict
    result: bool


@dataclass(frozen=True)
class Graph:
    nodes: dict[str, Node]
    needs: dict[str, list[str]]
    order: list[str]
    result: str


def references(value: object) -> Iterator[str]:
    """Nodes that an argument refers to, however nested; callback graphs are closed worlds and are skipped."""
    if isinstance(value, dict):
        if "from_node" in value:
            yield value["from_node"]
        elif "process_graph" not in value:
            for v in value.values():
                yield from references(v)
    elif isinstance(value, list):
        for v in value:
            yield from references(v)


def parse(document: dict) -> Graph:
    """A checked graph from ``{"process": {"process_graph": ...}}``, ``{"process_graph": ...}`` or the node table itself."""
    table = document.get("process", document)
    table = table.get("process_graph", table) if isinstance(table, dict) else None
    if not isinstance(table, dict) or not table:
        raise GraphError("the process graph is empty")
    nodes = {}
    for name, n in table.items():
        if not isinstance(n, dict) or not isinstance(n.get("process_id"), str):
            raise GraphError(f"node {name!r} has no process_id")
        nodes[name] = Node(n["process_id"], n.get("arguments") or {}, bool(n.get("result")))
    results = [k for k, n in nodes.items() if n.result]
    if len(results) != 1:
        raise GraphError(f"exactly one node must be the result; {len(results)} are")
    needs = {k: list(dict.fromkeys(references(n.arguments))) for k, n in nodes.items()}
    for k, refs in needs.items():
        for r in refs:
            if r not in nodes:
                raise GraphError(f"node {k!r} refers to {r!r}, which is not there")
    depth: dict[str, int] = {}
    order: list[str] = []
    state: dict[str, int] = {}
    for start in nodes:
        stack = [(start, iter(needs[start]))] if start not in state else []
        if stack:
            state[start] = 1
        while stack:
            name, rest = stack[-1]
            for r in rest:
                if state.get(r) == 1:
                    raise GraphError(f"the graph has a cycle through {r!r}")
                if r not in state:
                    state[r] = 1
                    stack.append((r, iter(needs[r])))
                    break
            else:
                stack.pop()
                state[name] = 2
                depth[name] = 1 + max((depth[r] for r in needs[name]), default=0)
                order.append(name)
    if max(depth.values()) > MAX_DEPTH:
        raise GraphError(f"the graph is deeper than {MAX_DEPTH}")
    return Graph(nodes, needs, order, results[0])


def ancestors(graph: Graph, name: str) -> set[str]:
    out, rest = set(), [name]
    while rest:
        n = rest.pop()
        if n not in out:
            out.add(n)
            rest += graph.needs[n]
    return out
