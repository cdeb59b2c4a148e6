"""Duplicate detection and review over DataFrames."""
