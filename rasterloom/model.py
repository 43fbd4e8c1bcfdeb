"""The cube: lazy band expressions over a shared row set.

Rows are keyed by (scene, y, x), or by (y, x) once time is reduced; a band is a Column over the columns of the cube's
``Base``. Row-preserving processes only change expressions, so cubes of one base merge without a join, and temporal
reductions of one base share a single aggregation (``Grouped`` collects them until somebody reads).
"""

from __future__ import annotations

import re
from collections.abc import Mapping
from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .errors import GraphError, MissingBand

KEYS = ("scene", "t", "y", "x")
CLASS_BANDS = ("SCL", "scl")
# The index bands that are the primary one if a cube has them, first one first.
INDEX_BANDS = ("ndvi", "ndmi", "ndwi", "evi", "savi", "msavi")
_NAME = re.compile(r"(?![-.])(?!.*\.\.)[A-Za-z0-9_.-]{1,64}")


def check_name(name: str) -> str:
    """A band, label or dimension name that is safe as a column and in a path."""
    if not isinstance(name, str) or not _NAME.fullmatch(name) or name in KEYS:
        raise GraphError(f"not a valid name: {name!r}")
    return name


class Base:
    """A row set with the keys and source columns that band expressions refer to."""

    def __init__(self, frame: DataFrame, timeless: bool = False) -> None:
        self._frame, self.timeless, self.groups = frame, timeless, {}
        self.held: dict[str, tuple[str, Column, int]] = {}

    @property
    def keys(self) -> list[str]:
        return ["y", "x"] if self.timeless else list(KEYS)

    def hold(self, value: Column) -> Column:
        """A column that stands for ``value``. What is used more than once is held, else nested expressions multiply."""
        text = str(value)
        if re.fullmatch(r"Column<'\w+'>", text):
            return value
        if text not in self.held:
            own = [layer for name, _, layer in self.held.values() if re.search(rf"\b{name}\b", text)]
            self.held[text] = f"_h{len(self.held)}", value, 1 + max(own, default=0)
        return F.col(self.held[text][0])

    def source(self) -> DataFrame:
        return self._frame

    def frame(self) -> DataFrame:
        """The rows with all held columns; Catalyst drops those that nobody reads."""
        out = self.source()
        for layer in sorted({layer for _, _, layer in self.held.values()}):
            out = out.withColumns({name: c for name, c, own in self.held.values() if own == layer})
        return out


class Grouped(Base):
    """One row for each pixel of ``parent``; aggregates are added by whoever needs them and run together."""

    def __init__(self, parent: Base, by: tuple[str, ...]) -> None:
        self.parent, self.by, self.timeless, self.groups, self.held = parent, by, by == ("y", "x"), {}, {}
        self.aggregates: dict[str, tuple[str, Column]] = {}

    @property
    def keys(self) -> list[str]:
        return list(self.by)

    def add(self, aggregate: Column) -> Column:
        name, _ = self.aggregates.setdefault(str(aggregate), (f"_a{len(self.aggregates)}", aggregate))
        return F.col(name)

    def source(self) -> DataFrame:
        return self.parent.frame().groupBy(*self.by).agg(*(c.alias(n) for n, c in self.aggregates.values()))


@dataclass(frozen=True)
class Cube:
    base: Base
    bands: Mapping[str, Column]
    #: (scene, ISO time or None), in scene order
    scenes: tuple[tuple[int, str | None], ...] = ()
    #: band: (scale, offset), taken by the first ``apply`` on the band
    scales: Mapping[str, tuple[float, float]] = field(default_factory=dict)
    transform: tuple[float, ...] = (0.0, 1.0, 0.0, 0.0, 0.0, -1.0)
    crs: str = "EPSG:4326"
    shape: tuple[int, int] | None = None
    extra_dims: Mapping[str, str] = field(default_factory=dict)
    bbox: Mapping[str, float] | None = None
    provenance: tuple[str, ...] = ()

    def band(self, name: str) -> Column:
        if name not in self.bands:
            raise MissingBand(f"no band {name!r}; there are {sorted(self.bands)}")
        return self.bands[name]

    @property
    def names(self) -> list[str]:
        return sorted(self.bands)

    @property
    def data_bands(self) -> list[str]:
        return [b for b in self.names if b not in CLASS_BANDS]

    @property
    def primary(self) -> str:
        """The first index band, else the first band that is not a class band."""
        for name in (*INDEX_BANDS, *self.data_bands, *self.names):
            if name in self.bands:
                return name
        raise MissingBand("the cube has no bands")

    def frame(self) -> DataFrame:
        """Keys and bands, in name order."""
        return self.base.frame().select(*self.base.keys, *(self.bands[b].alias(b) for b in self.names))

    def long(self) -> DataFrame:
        """keys, band, v: one row for each pixel and band that has a value."""
        wide, keys = self.frame(), self.base.keys
        return wide.unpivot(keys, [F.col(b).cast("double").alias(b) for b in self.names], "band", "v").where("v is not null")

    def with_bands(self, bands: Mapping[str, Column], **more) -> Cube:
        return replace(self, bands=dict(bands), scales={b: s for b, s in self.scales.items() if b in bands}, **more)

    def settled(self) -> Cube:
        """The same cube over a base of its own: bands become plain columns."""
        base = Base(self.frame(), self.base.timeless)
        return replace(self, base=base, bands={b: F.col(b) for b in self.names})

    def where(self, condition: Column, **more) -> Cube:
        """Fewer rows: a new base. The condition is on keys, so the scan gets it."""
        base = Base(self.frame().where(condition), self.base.timeless)
        return replace(self, base=base, bands={b: F.col(b) for b in self.names}, **more)


def from_frame(df: DataFrame, bands: list[str], scenes: list[tuple[int, str | None]] | None = None, **more) -> Cube:
    """A cube over a wide DataFrame with scene, t, y, x and the bands (t is added as NULL if it is not there)."""
    for b in bands:
        check_name(b)
    if "t" not in df.columns:
        df = df.withColumn("t", F.lit(None).cast("timestamp"))
    if "scene" not in df.columns:
        df = df.withColumn("scene", F.lit(0))
    return Cube(Base(df.select(*KEYS, *bands)), {b: F.col(b) for b in bands}, tuple(scenes or ((0, None),)), **more)
