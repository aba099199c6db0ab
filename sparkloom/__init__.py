"""Spark-native retrieval analytics: every operator takes and returns DataFrames."""
