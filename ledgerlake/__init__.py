"""Spark-native processing of financial filings and other paged documents."""
