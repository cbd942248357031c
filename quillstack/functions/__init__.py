"""Column-in, column-out functions: URLs, text, dates, small arrays."""
