"""Raster and table analytics expressed as Spark plans."""
