"""Dump files, checksum lists and stored graphs."""
