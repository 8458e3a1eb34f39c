"""Operators for preparing language-model training data.

Each module holds one operator with its own general interface; ``queries.py``
holds the thin registered queries that run them over the given tables.
Nothing else in the library imports this subpackage.
"""
