"""Datasets of several files: each file is a time step, its bands are layers; plus the blocks they are worked on in.

A file here is a Parquet table of pixels (y, x and one column for each band), as rasters are kept for Spark. The grid's
metadata comes from the first file or from a template.
"""

from __future__ import annotations

from dataclasses import dataclass, replace
from functools import reduce as fold

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..errors import GraphError, InvalidChunkPlan
from ..model import KEYS, Base, Cube


@dataclass(frozen=True)
class Block:
    """A rectangle of the grid and the window that is read for it, which a halo may widen (it is cut at the edges)."""

    row: int
    col: int
    y: int
    x: int
    rows: int
    cols: int
    read: tuple[int, int, int, int]


def blocks(shape: tuple[int, int], size: int = 2048, halo: int = 0) -> list[Block]:
    """Row by row; those at the edge are smaller."""
    if size < 1 or halo < 0:
        raise InvalidChunkPlan("a block needs a positive size and a halo of 0 or more")
    out = []
    for y in range(0, shape[0], size):
        for x in range(0, shape[1], size):
            rows, cols = min(size, shape[0] - y), min(size, shape[1] - x)
            y0, x0 = max(0, y - halo), max(0, x - halo)
            read = (y0, x0, min(shape[0], y + rows + halo) - y0, min(shape[1], x + cols + halo) - x0)
            out.append(Block(y // size, x // size, y, x, rows, cols, read))
    return out


def plan_chunk(budget_bytes: int, workers: int, value_bytes: int = 8, overhead: int = 16, tile: int = 512) -> int:
    """The side of square chunks so that every worker's fits the budget: 64 to 4096, in whole tiles if it is larger than one."""
    if budget_bytes <= 0 or workers <= 0:
        raise InvalidChunkPlan("the budget and the workers must be positive")
    side = int((budget_bytes / workers / (value_bytes + overhead)) ** 0.5)
    side = min(max(side, 64), 4096)
    return side // tile * tile if side > tile else side


@dataclass(frozen=True)
class DatasetBuilder:
    files: tuple[str, ...] = ()
    times: tuple[str | None, ...] = ()
    bands: tuple[str, ...] = ()
    transform: tuple[float, ...] = (0.0, 1.0, 0.0, 0.0, 0.0, -1.0)
    crs: str = "EPSG:4326"
    shape: tuple[int, int] | None = None
    block_size: int = 2048
    overlap: int = 0

    @classmethod
    def from_files(cls, files: list[str], times: list[str | None] | None = None) -> DatasetBuilder:
        return cls(tuple(files), tuple(times or [None] * len(files)))

    @classmethod
    def from_template(cls, cube: Cube) -> DatasetBuilder:
        return cls(bands=tuple(cube.names), transform=cube.transform, crs=cube.crs, shape=cube.shape)

    def with_(self, **changes: object) -> DatasetBuilder:
        return replace(self, **changes)

    def layer_mappings(self, spark: SparkSession) -> DataFrame:
        """file, band, time_pos, layer_pos: where each band of each file stands. All files have the same bands."""
        rows = []
        for t, path in enumerate(self.files):
            own = tuple(c for c in spark.read.parquet(path).columns if c not in KEYS)
            if t and own != first:
                raise GraphError(f"{path!r} has the bands {own}, the first file {first}")
            first = own
            rows += [(path, b, t, k) for k, b in enumerate(own)]
        return spark.createDataFrame(rows, "file string, band string, time_pos int, layer_pos int")

    def blocks(self) -> list[Block]:
        if not self.shape:
            raise GraphError("the dataset has no shape")
        return blocks(self.shape, self.block_size, self.overlap)

    def build(self, spark: SparkSession) -> Cube:
        """A lazy cube; without files, an empty one."""
        scenes = tuple(enumerate(self.times)) or ((0, None),)
        if not self.files:
            schema = ", ".join(["scene int, t timestamp, y int, x int", *(f"`{b}` double" for b in self.bands)])
            return Cube(Base(spark.createDataFrame([], schema)), {b: F.col(b) for b in self.bands}, scenes, transform=self.transform, crs=self.crs, shape=self.shape)
        frames = []
        for k, (path, t) in enumerate(zip(self.files, self.times, strict=True)):
            frame = spark.read.parquet(path)
            bands = self.bands or tuple(c for c in frame.columns if c not in KEYS)
            frames.append(frame.select(F.lit(k).alias("scene"), F.to_timestamp(F.lit(t)).alias("t"), "y", "x", *bands))
        return Cube(Base(fold(DataFrame.unionByName, frames)), {b: F.col(b) for b in bands}, scenes, transform=self.transform, crs=self.crs, shape=self.shape, provenance=self.files)
