"""Cohort analytics on Spark: tidy long tables in, DataFrames out."""
