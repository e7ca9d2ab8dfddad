"""Capacity analytics over operational time-series, written as Spark DataFrame operators."""
