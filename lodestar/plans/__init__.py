"""Registered queries: operators applied to the bound tables, each with its SQL twin."""
