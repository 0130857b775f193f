"""Retrieval over typed knowledge graphs, expressed as Spark DataFrame operations."""
