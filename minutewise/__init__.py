"""Minute-grid telemetry analytics on PySpark DataFrames."""
