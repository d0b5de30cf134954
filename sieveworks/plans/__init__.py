"""Registered queries: operators applied to tables."""
