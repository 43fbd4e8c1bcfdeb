"""What each process takes; a star marks an optional parameter. Discovery and validation read this table."""

from __future__ import annotations


def _rows(category: str, *rows: str) -> list[dict]:
    return [{"id": r.split()[0], "category": category, "parameters": r.split()[1:]} for r in rows]


# Process ids and their parameters.
PROCESSES: list[dict] = [
    *_rows(
        "cubes",
        "load_collection id spatial_extent temporal_extent *bands *properties *limit",
        "save_result data *format *options",
        "reduce_dimension data reducer dimension *context",
        "apply data *process *context",
        "mask data mask *replacement",
        "merge_cubes cube1 cube2 *overlap_resolver *context",
        "ndvi data *nir *red *target_band",
        "filter_temporal data extent *dimension",
        "filter_spatial data geometries",
        "filter_bbox data extent",
        "filter_bands data bands",
        "rename_labels data dimension target *source",
        "add_dimension data name label *type",
        "drop_dimension data name",
        "resample_spatial data projection *resolution *method",
        "aggregate_spatial data geometries reducer *target_dimension *context",
        "mask_scl_dilation data *scl_band_name *mask2_values *kernel_size",
        "mask_from_values data *band *values *target_band",
        "aggregate_spatial_polygon data geometries",
        "aggregate_spatial_point data points",
        "zonal_histogram data mask",
    ),
    *_rows("machine learning", "fit_classifier x y *iterations *lr", "predict_classifier model x"),
    *_rows(
        "math",
        *(f"{n} x y" for n in ("add", "subtract", "multiply", "divide", "mod", "normalized_difference")),
        *(f"{n} x" for n in ("absolute", "sqrt", "ln", "sgn", "floor", "ceil", "int", "cos", "sin", "tan", "arccos", "arcsin", "arctan")),
        "power base p", "exp p", "log x base", "round x *p", "clip x min max", "arctan2 y x",
    ),
    *_rows("comparison", "eq x y *delta *case_sensitive", "neq x y *delta *case_sensitive", "gt x y", "gte x y", "lt x y", "lte x y", "between x min max *exclude_max"),
    *_rows("logic", "and x y", "or x y", "xor x y", "not x"),
    *_rows(
        "arrays",
        "array_element data *index *label *return_nodata", "array_create *data *repeat", "array_concat array1 array2", "array_append data value", "array_contains data value",
        "array_find data value", "count data *condition", "order data *asc *nodata", "sort data *asc *nodata",
    ),
]
FORMATS = {"input": ["PARQUET", "CSV", "JSON"], "output": ["GTIFF", "COG", "JSON", "PNG", "NETCDF", "PARQUET"]}


def processes() -> list[dict]:
    return sorted(PROCESSES, key=lambda p: p["id"])


def file_formats() -> dict:
    return FORMATS


def service_types() -> dict:
    return {}


def udf_runtimes() -> dict:
    return {}
