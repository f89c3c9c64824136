"""Column expressions: cell cleaning, conversion, formatting, messages."""
