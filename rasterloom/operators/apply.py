"""Per-pixel maps: expressions in the scan's stage, never Python."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import functions as F

from ..functions.scalar import finite
from ..model import CLASS_BANDS, Cube, check_name
from ..plans.callback import compile_apply


def apply(cube: Cube, process: object | None = None) -> Cube:
    """A callback on every band but class bands. A band's scale and offset are applied first, once."""
    if process is None:
        return cube
    bands = {}
    for b, c in cube.bands.items():
        if b in CLASS_BANDS:
            bands[b] = c
            continue
        scale, offset = cube.scales.get(b, (1.0, 0.0))
        v = finite(cube.base.hold(c.cast("double")))
        bands[b] = compile_apply(process, v if (scale, offset) == (1.0, 0.0) else v * scale + offset, cube.base.hold)
    return replace(cube, bands=bands, scales={})


def ndvi(cube: Cube, nir: str = "B08", red: str = "B04", target_band: str = "ndvi") -> Cube:
    """(nir - red) / (nir + red) in place of both; NULL unless both are positive and their sum is 1 or more."""
    n, r = cube.base.hold(cube.band(nir).cast("double")), cube.base.hold(cube.band(red).cast("double"))
    value = F.when((n > 0) & (r > 0) & (F.abs(n + r) >= 1), (n - r) / (n + r))
    return cube.with_bands({**{b: c for b, c in cube.bands.items() if b not in (nir, red)}, check_name(target_band): value})
