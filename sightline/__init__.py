"""Sightings analytics on Spark DataFrames, SQL functions and Structured Streaming."""
