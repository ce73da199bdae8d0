"""Joins, aggregations and windows: ``DataFrame -> DataFrame`` transforms."""
