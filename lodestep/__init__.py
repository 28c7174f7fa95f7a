"""Redirect-resolved page graphs and shortest paths over them, as DataFrame operations."""
