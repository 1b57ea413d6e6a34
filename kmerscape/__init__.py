"""Spark-native k-mer uniqueness analytics over sequences."""
