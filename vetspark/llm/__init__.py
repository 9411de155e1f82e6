"""Operators for preparing language-model training data.

Nothing else in the library imports this subpackage.  Queries over the
standard tables are in :mod:`vetspark.llm.queries`.
"""
