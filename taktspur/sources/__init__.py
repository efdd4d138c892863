"""Readers, writers and the set logic of daily loads."""
