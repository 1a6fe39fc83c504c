"""Column functions: text, sizes, similarity, keys and display."""
