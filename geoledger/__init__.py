"""Geo-tabular analytics on PySpark: field measurements and map layers to clean, auditable, model-ready tables and grids."""
