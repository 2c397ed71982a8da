"""Typed loads, literal dimensions and stored tables."""
