"""Watermark-based change-data reconciliation on Spark DataFrames."""
