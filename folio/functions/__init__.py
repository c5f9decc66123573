"""Column functions: text in, columns out, built-in expressions only."""
