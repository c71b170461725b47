"""Readers, writers and the work area for intermediate tables."""
