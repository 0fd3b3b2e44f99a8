"""Streaming readers."""
