"""Operators of a training-data pipeline: documents, pages and conversations.

Nothing else in the library imports this subpackage. Operators take DataFrames and
column names and return DataFrames; ``queries`` registers one query for each.
"""
