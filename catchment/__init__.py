"""catchment: drainage-grid analytics expressed as PySpark DataFrame work."""
