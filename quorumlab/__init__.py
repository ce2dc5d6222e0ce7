"""Peer-review analytics on Spark DataFrames."""
