"""Readers that land tables, feeds and whole-text corpora as DataFrames."""
