"""Readers of recorded sequences."""
