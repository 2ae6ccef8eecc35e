"""Readers, writers and the prompt catalogue."""
