"""Operators for cleaning, encoding and scoring training text, and their queries."""
