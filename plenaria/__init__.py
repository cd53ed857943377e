"""Longitudinal discourse analytics expressed as PySpark DataFrames."""
