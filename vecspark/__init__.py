"""vecspark: embedding compression, retrieval and corpus processing on PySpark."""
