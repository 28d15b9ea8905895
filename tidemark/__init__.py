"""Tidemark: market-telemetry analytics and training-data operators on PySpark."""
