"""Tensors fed by streams."""
