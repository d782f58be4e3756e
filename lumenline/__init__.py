"""Spark-native analytics over timestamped text: retrieval, alignment, sequences, vectors and audits."""
