"""Where a result comes from."""

from __future__ import annotations

import json
from typing import Any

from ..model import Cube
from ..sinks.result import Result


def graph_hash(graph: dict) -> str:
    """FNV-1a, 64 bits, over the graph as canonical JSON."""
    h = 0xCBF29CE484222325
    for b in json.dumps(graph, sort_keys=True, separators=(",", ":")).encode():
        h = (h ^ b) * 0x100000001B3 & 0xFFFFFFFFFFFFFFFF
    return f"{h:016x}"


def record(graph: dict, value: Any) -> dict:
    cube = value.data if isinstance(value, Result) else value
    out = {"graph_hash": graph_hash(graph)}
    if isinstance(cube, Cube):
        out |= {"scenes": [t for _, t in cube.scenes], "sources": list(cube.provenance), "scales": {b: list(s) for b, s in cube.scales.items()}, "crs": cube.crs}
    return out
