"""Spark-native analytics over datasets of wording variants and model responses."""
