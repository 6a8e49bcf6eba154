"""Recommendation and experimentation analytics as plain PySpark DataFrame operators."""
