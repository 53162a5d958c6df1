"""Scorebook: incremental, event-level sports analytics on Spark DataFrames."""
