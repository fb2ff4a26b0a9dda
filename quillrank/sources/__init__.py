"""Readers: every reader declares its schema and returns a DataFrame."""
