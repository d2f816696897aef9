"""Operators for preparing large text corpora: one module for each operator, all DataFrame in, DataFrame out."""
