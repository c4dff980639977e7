"""Readers: URL lists, JSON lines and article XML."""
