"""Operators over review, claim, score and label tables: DataFrames in, DataFrames out."""
