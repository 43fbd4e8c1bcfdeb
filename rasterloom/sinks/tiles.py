"""Cubes as tables of tiles: one row for each scene, band and block, with the block's values as bytes."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..model import Cube, from_frame

SCHEMA = "scene int, t timestamp, band string, block_row int, block_col int, rows int, cols int, data binary"


def to_tiles(cube: Cube, block: int = 512) -> DataFrame:
    """float64 values in row order, missing ones NaN. A tile has a bounded size, so a group fits a task."""
    rows_all, cols_all = cube.shape or (None, None)

    def pack(pdf: pd.DataFrame) -> pd.DataFrame:
        r, c, scene, band = int(pdf.block_row.iloc[0]), int(pdf.block_col.iloc[0]), int(pdf.scene.iloc[0]), pdf.band.iloc[0]
        rows = min(block, rows_all - r * block) if rows_all else block
        cols = min(block, cols_all - c * block) if cols_all else block
        out = np.full((rows, cols), np.nan)
        out[pdf.y.to_numpy() - r * block, pdf.x.to_numpy() - c * block] = pdf.v.to_numpy()
        return pd.DataFrame({"scene": [scene], "t": [pdf.t.iloc[0]], "band": [band], "block_row": [r], "block_col": [c], "rows": [rows], "cols": [cols], "data": [out.tobytes()]})

    long = cube.long()
    if cube.base.timeless:
        long = long.withColumns({"scene": F.lit(0), "t": F.lit(None).cast("timestamp")})
    placed = long.withColumns({"block_row": F.floor(F.col("y") / block).cast("int"), "block_col": F.floor(F.col("x") / block).cast("int")})
    return placed.groupBy("scene", "band", "block_row", "block_col").applyInPandas(pack, SCHEMA)


def from_tiles(tiles: DataFrame, bands: list[str], block: int = 512, **more) -> Cube:
    """A cube from such a table."""

    def unpack(frames):
        for pdf in frames:
            for t in pdf.itertuples():
                values = np.frombuffer(t.data).reshape(t.rows, t.cols)
                y, x = np.nonzero(~np.isnan(values))
                yield pd.DataFrame({"scene": t.scene, "t": t.t, "band": t.band, "y": (y + t.block_row * block).astype("int32"), "x": (x + t.block_col * block).astype("int32"), "v": values[y, x]})

    long = tiles.where(F.col("band").isin(bands)).mapInPandas(unpack, "scene int, t timestamp, band string, y int, x int, v double")
    wide = long.groupBy("scene", "t", "y", "x").pivot("band", bands).agg(F.first("v"))
    return from_frame(wide, bands, **more)
