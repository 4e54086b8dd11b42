"""Relationship graphs over tables of source files, built on Spark DataFrames."""
