"""Joins, windows, aggregations and set operations over events, trials and samples."""
