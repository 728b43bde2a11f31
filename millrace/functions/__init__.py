"""Column functions: dynamic-value semantics, text, numbers and URLs."""
