"""Operators of a large-scale training-data pipeline (thirteen operators and their queries).

Nothing else in the library imports this subpackage; ``queries`` holds the
registered queries and their DuckDB twins.
"""
