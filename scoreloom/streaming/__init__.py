"""The same functions over arriving data."""
