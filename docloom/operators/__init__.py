"""Operators over any DataFrame and over the structure of documents."""
