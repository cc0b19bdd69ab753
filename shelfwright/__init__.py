"""Catalog engine on PySpark: normalization, entity resolution, merge, serving and request-stream analytics."""
