"""Weftline: Spark-native preparation, running and analysis of text batches."""
