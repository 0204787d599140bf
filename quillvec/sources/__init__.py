"""Readers and writers of vector files, and generators."""
