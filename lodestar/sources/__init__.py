"""Readers, writers and the binding of raw tables to the recommendation data model."""
