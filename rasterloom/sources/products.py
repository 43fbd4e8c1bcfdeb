"""Known products, providers and band names."""

from __future__ import annotations

from ..errors import GraphError, MissingBand

# Names of bands by product family, product ids by provider, and the products' properties.
BAND_ALIASES = {
    "B01": ("coastal", "B1"),
    "B02": ("blue", "B2"),
    "B03": ("green", "B3"),
    "B04": ("red", "Red", "B4"),
    "B05": ("rededge1", "rededge", "B5"),
    "B06": ("rededge2", "B6"),
    "B07": ("rededge3", "B7"),
    "B08": ("nir", "Nir", "NIR", "B8"),
    "B8A": ("nir08", "B8a"),
    "B09": ("nir09", "watervapor", "B9"),
    "B11": ("swir16", "SWIR16", "B11_swir"),
    "B12": ("swir22", "SWIR22", "B12_swir"),
    "SCL": ("scl",),
}
CANONICAL = {
    "sentinel2": {"blue": "B02", "green": "B03", "red": "B04", "nir": "B08", "swir1": "B11", "swir2": "B12"},
    "landsat8": {"blue": "blue", "green": "green", "red": "red", "nir": "nir08", "swir1": "swir16", "swir2": "swir22"},
    "landsat7": {"blue": "blue", "green": "green", "red": "red", "nir": "nir08"},
    "landsat5": {"blue": "blue", "green": "green", "red": "red", "nir": "nir08"},
}
COLLECTIONS = {
    "earth_search": {"sentinel2": "sentinel-2-l2a", "landsat8": "landsat-c2-l2", "landsat7": "landsat-c2-l2", "landsat5": "landsat-c2-l2"},
    "planetary_computer": {"sentinel2": "sentinel-2-l2a", "landsat8": "landsat-c2-l2", "landsat7": "landsat-c2-l2", "landsat5": "landsat-c2-l2"},
    "dea": {"sentinel2": "ga_s2am_ard_3"},
    "usgs": {"landsat8": "landsat-c2l2-sr"},
}
PRODUCTS = [
    {"id": "sentinel-2-l2a", "title": "Sentinel-2 Level-2A", "resolution": 10.0, "mask": "scl", "red": ["red", "B04", "b04"], "nir": ["nir", "B08", "b08"], "swir2": ["swir22", "B12", "b12"], "class": ["scl", "SCL"]},
    {"id": "sentinel-2-l1c", "title": "Sentinel-2 Level-1C", "resolution": 10.0, "mask": "none", "red": ["red", "B04"], "nir": ["nir", "B08"], "swir2": ["swir22", "B12"], "class": []},
    {"id": "landsat-c2-l2", "title": "Landsat Collection 2 Level-2", "resolution": 30.0, "mask": "qa_pixel", "red": ["red", "SR_B4"], "nir": ["nir08", "SR_B5"], "swir2": ["swir22", "SR_B7"], "class": ["qa_pixel", "QA_PIXEL"]},
    {"id": "cop-dem-glo-30", "title": "Copernicus DEM 30 m", "resolution": 30.0, "mask": "none", "red": ["data"], "nir": ["data"], "swir2": [], "class": []},
]


def resolve_band(wanted: str, there: list[str]) -> str | None:
    """The name under which a scene has the band: its own name first, then its aliases in order."""
    return next((n for n in (wanted, *BAND_ALIASES.get(wanted, ())) if n in there), None)


def collection_id(collection: str, provider: str) -> str:
    return COLLECTIONS.get(provider, {}).get(collection, "")


def canonical_band(name: str, collection: str) -> str:
    try:
        return CANONICAL[collection][name]
    except KeyError as x:
        raise MissingBand(f"no band {name!r} of {collection!r}") from x


def product(name: str) -> dict:
    for p in PRODUCTS:
        if p["id"] == name:
            return p
    raise GraphError(f"no product {name!r}")
