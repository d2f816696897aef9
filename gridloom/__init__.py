"""gridloom: tensors as coordinate relations, queried in index notation on Spark."""
