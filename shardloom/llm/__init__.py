"""Operators for preparing large text corpora.

Each operator module exposes a general interface on DataFrames; `queries.py`
holds the thin registered queries.  Nothing outside this folder imports it.
"""
