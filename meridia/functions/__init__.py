"""Column functions: plain Python functions that take and return Columns."""
