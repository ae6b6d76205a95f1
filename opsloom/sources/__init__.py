"""Readers, writers and the domain views derived from the base tables."""
