"""Reusable relational steps, built only from DataFrame operations."""
