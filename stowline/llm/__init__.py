"""Operators for training-data pipelines over tables of documents.

Nothing outside this subpackage imports it.
"""
