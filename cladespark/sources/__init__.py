"""Readers and writers for sequence, matrix and tree files."""
