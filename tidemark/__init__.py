"""Tidemark: analytics over versioned record logs, on Spark DataFrames."""
