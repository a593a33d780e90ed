"""Operators of a training-data pipeline: near-duplicate and substring
removal, decontamination, token files, web archives, language and quality
models, URL filters, mixing and sketches.

Nothing else in the library imports this subpackage.  Every operator takes a
DataFrame and returns a DataFrame; `queries.py` holds the thin registered
queries and their SQL.
"""
