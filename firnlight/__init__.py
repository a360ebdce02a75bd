"""Radar profiles as Spark DataFrames: processing, picking and analysis at scale."""
