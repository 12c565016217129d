"""Part of the catalog engine."""
