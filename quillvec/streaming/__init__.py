"""Streams of added and deleted vectors."""
