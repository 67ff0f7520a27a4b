"""Operators that prepare text for model training, and their queries."""
