"""Element types, algebras and elementwise functions."""
