"""Readers and writers of plain-text graphs."""
