"""Operators for preparing training corpora.

Nothing else in the package imports this subpackage.  Every operator takes a
DataFrame and column names and returns a DataFrame; the queries that apply them
to the standard tables are in ``queries.py``.
"""
