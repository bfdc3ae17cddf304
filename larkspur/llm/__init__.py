"""Operators for training-data pipelines over ``documents``-like tables.

Nothing outside this subpackage imports it.
"""
