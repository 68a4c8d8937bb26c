"""Operators for large-scale training-data pipelines.

Self-contained: nothing outside this subpackage imports it. Every operator
takes and returns DataFrames; the thin queries are in ``queries``.
"""
