"""A builder for image queries and comparison predicates."""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..errors import GraphError
from . import scenes as S
from .products import canonical_band, collection_id

_NAMES = {"<": "lt", ">": "gt", "<=": "lte", ">=": "gte", "==": "eq", "!=": "neq"}


@dataclass(frozen=True)
class Cmp:
    op: str
    value: float

    def to_query(self) -> dict:
        if self.op not in _NAMES:
            raise GraphError(f"no comparison {self.op!r}")
        return {_NAMES[self.op]: self.value}

    def column(self, c: Column) -> Column:
        self.to_query()
        return {"<": c < self.value, ">": c > self.value, "<=": c <= self.value, ">=": c >= self.value, "==": c == self.value, "!=": c != self.value}[self.op]


@dataclass(frozen=True)
class Intersects:
    """Exactly one of a bbox, scene ids or a geometry."""

    bbox: dict | None = None
    ids: tuple[str, ...] = ()
    geometry: dict | None = None

    def __post_init__(self) -> None:
        if sum(map(bool, (self.bbox, self.ids, self.geometry))) != 1:
            raise GraphError("give one of bbox, ids and geometry")

    def box(self) -> dict | None:
        if self.geometry:
            from ..operators.filters import _coordinates

            xs, ys = zip(*_coordinates(self.geometry), strict=True)
            return {"west": min(xs), "south": min(ys), "east": max(xs), "north": max(ys)}
        return self.bbox


@dataclass(frozen=True)
class ImageQuery:
    provider: str = ""
    collection: str = ""
    intersects: Intersects | None = None
    datetime: tuple[str | None, str | None] | None = None
    bands: tuple[str, ...] = ()
    cloudcover: Cmp | None = None
    limit: int = 100

    def with_(self, **changes: object) -> ImageQuery:
        return replace(self, **changes)

    def items(self, scenes: DataFrame) -> DataFrame:
        if not (self.provider and self.collection and self.intersects):
            raise GraphError("provider, collection and intersects are required")
        name = collection_id(self.collection, self.provider)
        held = scenes if self.cloudcover is None else scenes.where(self.cloudcover.column(F.col("cloud")))
        return S.search(held, [name], self.intersects.box(), self.datetime, list(self.intersects.ids) or None, None, self.limit)

    def hrefs(self, scenes: DataFrame) -> DataFrame:
        """id, band, href, path (for a virtual file system), in band order."""
        bands = [canonical_band(b, self.collection) for b in self.bands]
        pairs = F.explode(F.array(*(F.struct(F.lit(b).alias("band"), F.try_element_at("bands", F.lit(b)).alias("href")) for b in bands)))
        return self.items(scenes).select("id", pairs.alias("p")).select("id", "p.band", "p.href", vsi(F.col("p.href")).alias("path"))


def vsi(href: Column) -> Column:
    """Object-store and web addresses as virtual paths; others stay."""
    out = href
    for scheme, prefix in (("s3", "/vsis3/"), ("gs", "/vsigs/"), ("az", "/vsiaz/")):
        out = F.regexp_replace(out, f"^{scheme}://", prefix)
    return F.regexp_replace(out, "^(https?://)", "/vsicurl/$1")


def check_url(url: str) -> str:
    """Reject addresses that are not plain web or object-store ones, or that name this host or a private network."""
    import ipaddress
    from urllib.parse import urlparse

    parts = urlparse(url)
    if parts.scheme not in ("http", "https", "s3", "gs", "az") or not parts.hostname:
        raise GraphError(f"not an allowed address: {url!r}")
    host = parts.hostname.lower()
    if host == "localhost" or host.endswith((".localhost", ".local", ".internal")):
        raise GraphError(f"not an allowed host: {host!r}")
    try:
        ip = ipaddress.ip_address(host)
    except ValueError:
        return url
    if not ip.is_global:
        raise GraphError(f"not an allowed host: {host!r}")
    return url
