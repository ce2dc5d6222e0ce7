"""Structured Streaming forms of the community counts."""
