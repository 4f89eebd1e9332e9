"""Operators for large-scale training-data pipelines.

Nothing outside this subpackage imports it. Every operator takes and returns
DataFrames; ``queries`` registers one thin query for each of them.
"""
