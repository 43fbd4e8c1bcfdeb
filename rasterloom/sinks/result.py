"""Results that are saved: formats, the band that is shown, and writers."""

from __future__ import annotations

import json
from dataclasses import dataclass, field
from typing import Any

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..errors import BackendError
from ..model import Cube
from ..sources.extent import parse_crs
from . import encode

# Format names and what they mean; NetCDF results are TIFF bytes, and names not listed are GTIFF.
FORMATS = {"GTIFF": "GTIFF", "TIFF": "GTIFF", "GEOTIFF": "GTIFF", "COG": "GTIFF", "NETCDF": "GTIFF", "NC": "GTIFF", "PNG": "PNG", "JSON": "JSON", "PARQUET": "PARQUET"}
MAX_PIXELS = 64_000_000  # of a raster that becomes bytes on the driver; larger ones are written as tables of tiles
MAX_ROWS = 1_000_000  # of a table that becomes JSON on the driver


@dataclass
class Result:
    data: Any
    format: str
    options: dict = field(default_factory=dict)

    @classmethod
    def of(cls, data: Any, format: str | None = None, options: dict | None = None) -> Result:  # noqa: A002
        if isinstance(data, Result):
            data = data.data
        if format is None:
            kind = "GTIFF" if isinstance(data, Cube) or isinstance(data, int | float) and not isinstance(data, bool) else "JSON"
        else:
            kind = FORMATS.get(format.upper(), "GTIFF")
        return cls(data, kind, options or {})

    def frame(self) -> DataFrame:
        """What is shown: the primary band of the first scene, or the frame itself."""
        return shown(self.data) if isinstance(self.data, Cube) else self.data

    def to_bytes(self) -> bytes:
        if self.format == "JSON":
            return json.dumps(self._plain()).encode()
        values = grid(self.data) if isinstance(self.data, Cube) else np.array([[_float(self.data)]])
        if self.format == "PNG":
            return encode.png(encode.stretch(values))
        own = self.data if isinstance(self.data, Cube) else None
        return encode.tiff(values, own.transform if own else (0, 1, 0, 0, 0, -1), parse_crs(own.crs) if own else 4326)

    def _plain(self) -> Any:
        if isinstance(self.data, Cube):
            values = grid(self.data)
            return {"band": self.data.primary, "shape": list(values.shape), "values": [[None if np.isnan(v) else float(v) for v in row] for row in values]}
        if isinstance(self.data, DataFrame):
            rows = self.data.limit(MAX_ROWS + 1).collect()
            if len(rows) > MAX_ROWS:
                raise BackendError(f"more than {MAX_ROWS} rows are too many for one file; save as PARQUET")
            return [r.asDict(recursive=True) for r in rows]
        return self.data

    def write(self, path: str) -> str:
        """Cubes as a partitioned table at any size (``PARQUET``), other formats as one file through Spark's file systems."""
        if self.format == "PARQUET":
            frame = self.data.frame() if isinstance(self.data, Cube) else self.data
            frame.write.mode("overwrite").parquet(path)
            return path
        from pyspark.sql import SparkSession

        sc = SparkSession.active().sparkContext
        where = sc._jvm.org.apache.hadoop.fs.Path(path)
        out = where.getFileSystem(sc._jsc.hadoopConfiguration()).create(where, True)
        out.write(bytearray(self.to_bytes()))
        out.close()
        return path


def _float(v: Any) -> float:
    return float(v) if isinstance(v, int | float) else float("nan")


def shown(cube: Cube) -> DataFrame:
    """y, x, v of the primary band's first scene."""
    frame = cube.base.frame() if cube.base.timeless else cube.base.frame().where("scene = 0")
    return frame.select("y", "x", cube.band(cube.primary).cast("double").alias("v"))


def grid(cube: Cube) -> np.ndarray:
    """The shown band as an array, missing pixels NaN. Its size is checked before it is collected."""
    frame = shown(cube)
    if cube.shape:
        rows, cols = cube.shape
    else:
        last = frame.agg(F.max("y"), F.max("x")).first()
        rows, cols = (last[0] or 0) + 1, (last[1] or 0) + 1
    if rows * cols > MAX_PIXELS:
        raise BackendError(f"{rows} x {cols} pixels are too many for one file; save as PARQUET")
    out = np.full((rows, cols), np.nan)
    table = frame.where("v is not null").toArrow()
    y, x = table.column("y").to_numpy(), table.column("x").to_numpy()
    ok = (y >= 0) & (y < rows) & (x >= 0) & (x < cols)
    out[y[ok], x[ok]] = table.column("v").to_numpy()[ok]
    return out


def stretched(cube: Cube) -> DataFrame:
    """y, x, gray (0 to 255) of the shown band, as a distributed expression: one aggregate row is broadcast."""
    frame = shown(cube)
    ends = frame.agg(F.min("v").alias("_low"), F.max("v").alias("_high"))
    eps = float(np.finfo(np.float32).eps)
    gray = F.rint((F.col("v") - F.col("_low")) / F.greatest(F.col("_high") - F.col("_low"), F.lit(eps)) * 255)
    return frame.join(F.broadcast(ends), how="left").select("y", "x", F.coalesce(gray, F.lit(0.0)).cast("int").alias("gray"))


def manifest(job: str, created: str, assets: dict[str, dict]) -> dict:
    """A STAC item of a job's results; geometry and bbox are null."""
    return {"type": "Feature", "stac_version": "1.0.0", "id": job, "geometry": None, "bbox": None, "properties": {"datetime": created}, "links": [], "assets": assets}
