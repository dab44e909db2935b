"""Operators for large training-data corpora.

Nothing outside this subpackage imports it. Every operator is a function from
DataFrames to a DataFrame; the thin ``opN_*`` queries over the given tables
are in :mod:`taxonaut.llm.queries`.
"""
