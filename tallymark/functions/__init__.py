"""Column functions: each takes columns and returns a column, row by row, without a shuffle."""
