"""Kindred: record linkage and corpus analytics on Spark DataFrames."""
