"""Watching the databases folder."""
