"""Incremental pick-up of daily files."""
