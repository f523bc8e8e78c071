"""Spark-first engine for positioned text, long-form extracted fields and the reports built from them."""
