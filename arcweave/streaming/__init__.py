"""Continuous versions of operators."""
