"""Quality bands: Sentinel-2 scene classes, Landsat QA_PIXEL bits, brightness clouds, thresholds."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The unified mask codes, scene classes that map to one of them (all others are clear), the classes that count
# as cloud or shadow by default, those that count as clear, and the places of the QA_PIXEL flags.
NO_DATA, CLEAR, CLOUD, SHADOW, SNOW, WATER, SATURATED = range(7)
SCL_CODES = {0: NO_DATA, 1: SATURATED, 3: SHADOW, 6: WATER, 8: CLOUD, 9: CLOUD, 10: CLOUD, 11: SNOW}
SCL_MASKED = (3, 8, 9, 10, 11)
SCL_CLEAR = (4, 5, 6, 7, 11)
QA_BITS = {"fill": 0, "dilated_cloud": 1, "cirrus": 2, "cloud": 3, "cloud_shadow": 4, "snow": 5, "clear": 6, "water": 7}
QA_CONFIDENCES = {"cloud_confidence": 8, "cloud_shadow_confidence": 10, "snow_confidence": 12, "cirrus_confidence": 14}
CONFIDENCES = ("none", "low", "medium", "high")


def scl_to_mask(scl: Column) -> Column:
    out = F.when(scl.isNull(), None)
    for value, code in SCL_CODES.items():
        out = out.when(scl == value, code)
    return out.otherwise(CLEAR)


def scl_is_clear(scl: Column) -> Column:
    return scl.isin(*SCL_CLEAR)


def scl_clear_sky(scl: Column) -> Column:
    """Clear, water or snow in the unified codes."""
    return scl_to_mask(scl).isin(CLEAR, WATER, SNOW)


def qa_flag(qa: Column, name: str) -> Column:
    return qa.bitwiseAND(F.lit(1 << QA_BITS[name])) != 0


def qa_confidence(qa: Column, name: str) -> Column:
    """0 none, 1 low, 2 medium, 3 high."""
    return F.shiftright(qa, QA_CONFIDENCES[name]).bitwiseAND(F.lit(3))


def qa_to_mask(qa: Column) -> Column:
    """Fill, then cloud or dilated cloud, shadow, cirrus, snow, water; clear otherwise."""
    chain = (("fill", NO_DATA), ("cloud", CLOUD), ("dilated_cloud", CLOUD), ("cloud_shadow", SHADOW), ("cirrus", CLOUD), ("snow", SNOW), ("water", WATER))
    out = F.when(qa.isNull(), None)
    for name, code in chain:
        out = out.when(qa_flag(qa, name), code)
    return out.otherwise(CLEAR)


def qa_is_clear(qa: Column) -> Column:
    """The clear bit is set and none of the bits 2 to 5."""
    return qa_flag(qa, "clear") & (qa.bitwiseAND(F.lit(0b111100)) == 0)


def bright_cloud(blue: Column, nir: Column, swir2: Column, blue_min: float = 2000, nir_min: float = 2000, swir2_min: float = 1500) -> Column:
    """1 for cloud, 0 for clear."""
    return ((blue >= blue_min) & (nir >= nir_min) & (swir2 >= swir2_min)).cast("int")


def get_class(value: Column, thresholds: list[float]) -> Column:
    """How many thresholds come before the first one above the value; all of them if none is."""
    out = F.when(value.isNull(), None)
    for i, t in enumerate(thresholds):
        out = out.when(value < t, i)
    return out.otherwise(len(thresholds))
