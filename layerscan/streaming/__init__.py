"""Profiles of layers whose files keep arriving."""
