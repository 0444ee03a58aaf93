"""Operators of a large-scale training-data pipeline.

Nothing else in the library imports this subpackage; ``queries.py`` holds the
registered queries and their SQL.
"""
