"""Landscape metrics on Spark: categorical rasters as tables of cells."""
