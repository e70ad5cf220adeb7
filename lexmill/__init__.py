"""Spark-native document analytics: parsing, chunking, hybrid retrieval, answer checks, corpus quality."""
