"""Combining cubes. Cubes of one base merge without a join; others join on their keys."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import replace
from functools import reduce as fold

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..errors import CrsMismatch, GraphError, ResolutionMismatch
from ..model import KEYS, Base, Cube
from ..plans.callback import compile_array


def joined(one: Cube, two: Cube, how: str) -> tuple[Base, Mapping[str, Column], Mapping[str, Column]]:
    """A base that holds both cubes' bands, and the bands of either over it.

    Time aligns by scene number, not by timestamp. A cube without time joins every scene of the other by (y, x).
    """
    if one.base is two.base:
        return one.base, one.bands, two.bands
    a = one.frame().select(*one.base.keys, *(F.col(b).alias(f"_1{b}") for b in one.names))
    b = two.frame().select(*(k for k in two.base.keys if k != "t" or one.base.timeless), *(F.col(n).alias(f"_2{n}") for n in two.names))
    on = ["y", "x"] if one.base.timeless or two.base.timeless else ["scene", "y", "x"]
    if one.base.timeless and two.base.timeless or not one.base.timeless and not two.base.timeless:
        frame = a.join(b, on, how)
    else:
        if how == "full_outer" and one.base.timeless:
            how = "right"
        frame = a.join(b, on, "left" if how == "full_outer" else how)
    timeless = one.base.timeless and two.base.timeless
    if not timeless and "t" not in frame.columns:
        frame = frame.withColumn("t", F.lit(None).cast("timestamp"))
    base = Base(frame, timeless)
    return base, {n: F.col(f"`_1{n}`") for n in one.names}, {n: F.col(f"`_2{n}`") for n in two.names}


def merge_cubes(cube1: Cube, cube2: Cube, overlap_resolver: object | None = None) -> Cube:
    """Disjoint bands: all of them. Shared bands: what the resolver makes of [v1, v2]; without one, a mosaic."""
    shared = sorted(set(cube1.bands) & set(cube2.bands))
    if shared and overlap_resolver is None:
        return mosaic([cube1, cube2])
    if shared and len(cube1.scenes) != len(cube2.scenes) and not (cube1.base.timeless or cube2.base.timeless):
        raise GraphError("the cubes differ in their number of scenes")
    base, ours, theirs = joined(cube1, cube2, "full_outer")
    bands = {**theirs, **ours}
    for b in shared:
        bands[b] = compile_array(overlap_resolver, [ours[b], theirs[b]], base.hold)
    return replace(cube1, base=base, bands=bands, scales={**cube2.scales, **cube1.scales})


def mosaic(cubes: list[Cube]) -> Cube:
    """Pixel by pixel the last cube that has a value wins; grids must agree but for their origin, which may differ."""
    first = cubes[0]
    x0, dx, _, y0, _, dy = first.transform
    frames, names = [], sorted(set().union(*(c.bands for c in cubes)))
    for k, c in enumerate(cubes):
        if c.crs != first.crs:
            raise CrsMismatch("a mosaic needs one CRS")
        cx0, cdx, _, cy0, _, cdy = c.transform
        if (cdx, cdy) != (dx, dy):
            raise ResolutionMismatch("a mosaic needs one resolution")
        frame = c.frame()
        if c.base.timeless:
            frame = frame.withColumns({"scene": F.lit(0), "t": F.lit(None).cast("timestamp")})
        frame = frame.withColumns({"y": (F.col("y") + round((cy0 - y0) / dy)).cast("int"), "x": (F.col("x") + round((cx0 - x0) / dx)).cast("int")})
        frames.append(frame.select(*KEYS, *(F.col(b) if b in c.bands else F.lit(None).cast("double").alias(b) for b in names), F.lit(k).alias("_k")))
    rows = fold(DataFrame.unionByName, frames)
    last = [F.max_by(b, F.when(F.col(b).isNotNull(), F.col("_k"))).alias(b) for b in names]
    timeless = all(c.base.timeless for c in cubes)
    frame = rows.groupBy("scene", "y", "x").agg(F.max("t").alias("t"), *last)
    base = Base(frame.drop("scene", "t") if timeless else frame, timeless)
    return replace(first, base=base, bands={b: F.col(b) for b in names}, shape=None)


def extend(a: Cube, b: Cube) -> Cube:
    """``b``'s scenes after ``a``'s."""
    if a.names != b.names or a.crs != b.crs or a.shape != b.shape:
        raise GraphError("extend needs equal bands, CRS and shape")
    n = len(a.scenes)
    frame = a.frame().unionByName(b.frame().withColumn("scene", F.col("scene") + n))
    return replace(a, base=Base(frame), bands={c: F.col(c) for c in a.names}, scenes=(*a.scenes, *((s + n, t) for s, t in b.scenes)))


def stack(a: Cube, b: Cube) -> Cube:
    """``b``'s bands beside ``a``'s, numbered on where names clash; pixels that both have."""
    if len(a.scenes) != len(b.scenes):
        raise GraphError("stack needs equal times")
    base, ours, theirs = joined(a, b, "inner")
    bands = dict(ours)
    for name, column in theirs.items():
        own, k = name, 1
        while own in bands:
            own, k = f"{name}_{k}", k + 1
        bands[own] = column
    return replace(a, base=base, bands=bands)


def check_alignment(a: Cube, b: Cube, band: str = "") -> str | None:
    """None if the grids agree; else how to resample ``b``: nearest for class-like bands, bilinear for others."""
    if a.crs != b.crs:
        raise CrsMismatch(f"{a.crs} and {b.crs}")
    ax, adx, _, ay, _, ady = a.transform
    bx, bdx, _, by, _, bdy = b.transform
    if abs(adx - bdx) > 1e-3 * abs(adx) or abs(ady - bdy) > 1e-3 * abs(ady):
        return "nearest" if any(k in band.lower() for k in ("scl", "qa", "mask", "class")) else "bilinear"
    for u, v, d in ((ax, bx, adx), (ay, by, ady)):
        part = abs((u - v) / d) % 1
        if min(part, 1 - part) > 1e-3 * abs(d):
            raise ResolutionMismatch("the grids' origins are not a whole number of pixels apart")
    return None
