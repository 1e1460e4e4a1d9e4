"""folioflow: page-collection analytics as PySpark DataFrame jobs."""
