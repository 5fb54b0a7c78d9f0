"""Spark-first engine that turns web documents and requests into validated tables."""
