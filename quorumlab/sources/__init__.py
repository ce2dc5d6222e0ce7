"""Readers and writers: note pages, record lists, nested datasets, bibliographic works."""
