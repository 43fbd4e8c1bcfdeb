"""Masks. NULL is the masked value unless a replacement is given."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..errors import GraphError
from ..functions.qa import SCL_MASKED
from ..model import CLASS_BANDS, Cube, check_name
from .merge import joined


def mask(cube: Cube, masking: Cube, replacement: float | None = None) -> Cube:
    """Where the mask's one band is above 0, or has no pixel, values become ``replacement``; class bands stay."""
    if len(masking.bands) != 1:
        raise GraphError("a mask has exactly one band")
    if not masking.base.timeless and not cube.base.timeless and len(masking.scenes) != len(cube.scenes):
        raise GraphError("cube and mask differ in their number of scenes")
    name = masking.names[0]
    both, ours, theirs = joined(cube, masking, "left")
    if replacement is not None:
        replacement = float(min(max(replacement, -32768), 32767))
    hit = ~F.coalesce(theirs[name] <= 0, F.lit(False)) if masking.base is not cube.base else F.coalesce(theirs[name] > 0, F.lit(False))
    bands = {b: c if b in CLASS_BANDS else F.when(hit, F.lit(replacement).cast("double")).otherwise(c) for b, c in ours.items()}
    return replace(cube, base=both, bands=bands)


def mask_scl(cube: Cube, scl_band: str = "SCL", values: list[int] | None = None) -> Cube:
    """NULL in every band where the scene class is one of ``values``; the class band stays. There is no dilation."""
    hit = cube.band(scl_band).isin(*(SCL_MASKED if values is None else values))
    keep = ~F.coalesce(hit, F.lit(False))
    return cube.with_bands({b: c if b == scl_band else F.when(keep, c) for b, c in cube.bands.items()})


def mask_from_values(cube: Cube, band: str = "SCL", values: list[int] | None = None, target_band: str = "mask") -> Cube:
    """One band: 1 where the class is listed, else 0."""
    values = list(SCL_MASKED) if values is None else values
    if not 1 <= len(values) <= 4096 or any(not isinstance(v, int) or not 0 <= v <= 255 for v in values):
        raise GraphError("values are 1 to 4096 integers from 0 to 255")
    return cube.with_bands({check_name(target_band): cube.band(band).isin(*values).cast("int")})


def apply_clear(value: Column, clear: Column) -> Column:
    """The value where ``clear`` holds."""
    return F.when(clear, value)


def nearest_class(cube: DataFrame, classes: DataFrame, ratio_y: float, ratio_x: float, band: str = "SCL") -> DataFrame:
    """Give each pixel the class of the coarser grid's pixel that it lies in (nearest neighbour): an equi-join."""
    cy, cx = F.floor(F.col("y") * ratio_y).cast("int"), F.floor(F.col("x") * ratio_x).cast("int")
    theirs = classes.select("scene", F.col("y").alias("_cy"), F.col("x").alias("_cx"), band)
    return cube.withColumns({"_cy": cy, "_cx": cx}).join(theirs, ["scene", "_cy", "_cx"], "left").drop("_cy", "_cx")
