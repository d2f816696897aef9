"""Reading and writing tensors."""
