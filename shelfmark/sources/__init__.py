"""Readers for landed tables and platform payload files."""
