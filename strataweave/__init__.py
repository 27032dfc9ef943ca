"""Corpus ETL, retrieval and code-graph analytics over Spark DataFrames."""
