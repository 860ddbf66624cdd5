"""Assessment analytics on PySpark: extraction, pooling, variants, grading, reporting."""
