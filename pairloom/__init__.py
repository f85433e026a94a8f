"""Pairloom: record linkage and corpus preparation expressed as Spark DataFrames."""
