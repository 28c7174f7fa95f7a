"""Operators of the page graph: cleaning, search, paths and titles."""
