"""A Spark-first engine for raster process graphs and file pipelines."""
