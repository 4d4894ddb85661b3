"""Harmonisation, quality and cohort engine on PySpark DataFrames."""
