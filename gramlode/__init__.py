"""Byte n-gram search over Spark DataFrames."""
