"""Operators for preparing language-model training text, and their queries."""
