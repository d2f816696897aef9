"""Registered queries on the provided tables."""
