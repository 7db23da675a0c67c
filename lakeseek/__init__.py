"""Retrieval analytics over multi-tenant document collections, expressed on Spark DataFrames."""
