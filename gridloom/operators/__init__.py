"""Operators on tensors."""
