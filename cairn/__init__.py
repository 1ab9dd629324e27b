"""Spark-native jobs for annotated collections: DataFrames in, DataFrames out."""
