"""Spark-native analytics over text, ledgers and records: lazy functions from DataFrames to DataFrames."""
