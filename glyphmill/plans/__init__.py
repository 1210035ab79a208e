"""Registered queries: every operator on the given tables."""
