"""Formats, writers, routing and retention."""
