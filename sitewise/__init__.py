"""Facility siting analytics on Spark: grid, spatial joins, scores, selection, access."""
