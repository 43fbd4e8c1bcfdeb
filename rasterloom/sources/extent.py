"""Spatial and temporal extents as they come in requests."""

from __future__ import annotations

import re

from ..errors import GraphError


def parse_crs(value: object) -> int:
    """An EPSG number from 4326, "4326" or "EPSG:4326"."""
    m = re.fullmatch(r"(?:EPSG:)?(\d+)", str(value).strip(), re.IGNORECASE)
    if not m:
        raise GraphError(f"not a CRS: {value!r}")
    return int(m[1])


def parse_bbox(extent: dict) -> dict:
    try:
        w, s, e, n = (float(extent[k]) for k in ("west", "south", "east", "north"))
    except (KeyError, TypeError, ValueError) as x:
        raise GraphError("an extent needs the numbers west, south, east and north") from x
    if not (w < e and s < n):
        raise GraphError("an extent needs west < east and south < north")
    return {"west": w, "south": s, "east": e, "north": n, "crs": parse_crs(extent.get("crs") or 4326)}


def parse_interval(extent: list | None) -> tuple[str | None, str | None]:
    """ISO times; a date alone means its first or last second."""
    if extent is None:
        return None, None
    if not isinstance(extent, list | tuple) or len(extent) != 2:
        raise GraphError("a temporal extent is a pair")
    out = []
    for value, clock in zip(extent, ("T00:00:00Z", "T23:59:59Z"), strict=True):
        if value in (None, "", ".."):
            out.append(None)
        else:
            out.append(value + clock if re.fullmatch(r"\d{4}-\d\d-\d\d", value) else value)
    return out[0], out[1]


def parse_cloud_limit(properties: dict | None) -> float | None:
    """The bound of a ``lt`` or ``lte`` callback on eo:cloud_cover; other callbacks set none."""
    callback = (properties or {}).get("eo:cloud_cover")
    nodes = callback.get("process_graph", callback) if isinstance(callback, dict) else {}
    for node in nodes.values() if isinstance(nodes, dict) else ():
        if isinstance(node, dict) and node.get("process_id") in ("lt", "lte"):
            y = node.get("arguments", {}).get("y")
            if isinstance(y, int | float):
                return float(y)
    return None
