"""Insertion of streamed sequences into a kept tree."""
