"""Operators for preparing training data at scale.

Nothing outside this subpackage imports it; ``queries.py`` registers its
queries and SQL.
"""
