"""Corpus analytics on PySpark: facts, search, signals, graphs and summaries as DataFrames."""
