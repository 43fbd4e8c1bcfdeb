"""Scene catalogues: search, item helpers, and the loader that makes a cube of scenes and a pixel table.

A catalogue is a DataFrame of scenes: id, collection, t (ISO string), cloud (nullable), west, south, east, north, and
bands (map of band to href). Pixels are a wide table keyed by scene_id, y, x. Predicates go to both scans; only the chosen
scenes' ids and times, at most ``MAX_SCENES``, reach the driver.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..errors import BackendError, GraphError
from ..model import Base, Cube
from .extent import parse_bbox, parse_cloud_limit, parse_interval
from .products import resolve_band

MAX_SCENES = 50
DEFAULT_BANDS = ("B04", "B08", "SCL")


def search(scenes: DataFrame, collections: list[str] | None = None, bbox: dict | None = None, interval: list | None = None, ids: list[str] | None = None, max_cloud: float | None = None, limit: int = 100) -> DataFrame:
    """Matching scenes, clearest first (unknown cloud cover last); ids, if given, decide alone."""
    if ids:
        return scenes.where(F.col("id").isin(ids)).limit(limit)
    out = scenes
    if collections:
        out = out.where(F.col("collection").isin(collections))
    if bbox:
        b = parse_bbox(bbox)
        out = out.where((F.col("west") <= b["east"]) & (F.col("east") >= b["west"]) & (F.col("south") <= b["north"]) & (F.col("north") >= b["south"]))
    start, end = parse_interval(interval)
    if start:
        out = out.where(F.col("t") >= start)
    if end:
        out = out.where(F.col("t") <= end)
    if max_cloud is not None:
        out = out.where(F.col("cloud") < max_cloud)
    return out.orderBy(F.coalesce(F.col("cloud"), F.lit(101.0)), "t", "id").limit(limit)


def parse_query_interval(text: str) -> tuple[str | None, str | None]:
    """``a/b``, ``a/..``, ``../b`` or one instant."""
    a, _, b = text.partition("/")
    return parse_interval([a, b or a])


def loader(scenes: DataFrame, pixels: DataFrame, order: str = "cloud", **cube: object) -> Callable[..., Cube]:
    """A ``load_collection`` for process graphs. ``order`` of scenes: ``cloud`` (clearest first) or ``time``."""

    def load(name: str, spatial_extent=None, temporal_extent=None, bands=None, properties=None, limit=None) -> Cube:
        wanted = list(bands or DEFAULT_BANDS)
        n = min(max(int(limit or 3), 1), MAX_SCENES)
        found = search(scenes, [name], spatial_extent, temporal_extent, None, parse_cloud_limit(properties), n)
        rows = found.select("id", "t", "cloud", F.map_keys("bands").alias("there")).collect()  # MAX_SCENES at most
        if not rows:
            raise BackendError(f"no scene of {name!r} matches")
        if order == "time":
            rows.sort(key=lambda r: (r["t"] or "", r["id"]))
        names = {b: [resolve_band(b, r["there"]) for r in rows] for b in wanted}
        names = {b: set(own) for b, own in names.items() if all(own)}  # a band must be on every scene
        if not names:
            raise GraphError(f"no scene has any of the bands {wanted}")
        number = F.create_map(*[F.lit(x) for k, r in enumerate(rows) for x in (r["id"], k)])
        time = F.create_map(*[F.lit(x) for r in rows for x in (r["id"], r["t"])])
        held = pixels.where(F.col("scene_id").isin([r["id"] for r in rows]))
        columns = [F.coalesce(*(F.col(c) for c in sorted(own))).alias(b) for b, own in names.items()]
        frame = held.select(number[F.col("scene_id")].alias("scene"), F.to_timestamp(time[F.col("scene_id")]).alias("t"), "y", "x", *columns)
        times = tuple((k, r["t"]) for k, r in enumerate(rows)) if all(r["t"] for r in rows) else tuple((k, None) for k in range(len(rows)))
        return Cube(Base(frame), {b: F.col(b) for b in names}, times, **cube)

    return load


def asset_names(items: DataFrame) -> DataFrame:
    """Different band names over all items, sorted."""
    return items.select(F.explode(F.map_keys("bands")).alias("name")).distinct().orderBy("name")


def sources_for(items: DataFrame, band: str) -> DataFrame:
    return items.select("id", F.try_element_at("bands", F.lit(band)).alias("href")).where("href is not null")


def datetimes(items: DataFrame) -> DataFrame:
    return items.select("t").orderBy("t")


def items_on(items: DataFrame, date: str) -> DataFrame:
    return items.where(F.substring("t", 1, 10) == date)


def dates_in(items: DataFrame, start: str, end: str) -> DataFrame:
    day = F.substring("t", 1, 10)
    return items.select(day.alias("date")).where((F.col("date") >= start) & (F.col("date") <= end)).distinct().orderBy("date")


def on_tile(items: DataFrame, tile: str) -> DataFrame:
    return items.where(F.col("id").contains(f"_{tile}_"))


def swap_xy(points: Column) -> Column:
    return F.transform(points, lambda p: F.struct(p["y"].alias("x"), p["x"].alias("y")))


def numbered(scenes: DataFrame) -> DataFrame:
    """Scenes with their dense number in cloud order; a small table."""
    return scenes.withColumn("scene", F.row_number().over(Window.orderBy(F.coalesce("cloud", F.lit(101.0)), "t", "id")) - 1)
