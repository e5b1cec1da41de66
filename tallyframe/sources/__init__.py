"""Scans: delimited text and existing DataFrames."""
