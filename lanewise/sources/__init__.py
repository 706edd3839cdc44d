"""Reading and writing of the freight tables."""
