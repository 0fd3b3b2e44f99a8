"""Formats, parsers and readers."""
