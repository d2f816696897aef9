"""Index notation to DataFrame plans."""
