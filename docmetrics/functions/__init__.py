"""Column expressions: numbers, docstring text, scores, prices."""
