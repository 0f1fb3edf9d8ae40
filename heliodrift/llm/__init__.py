"""Operators for training-data pipelines: crawl records, text filters, search and tokens."""
