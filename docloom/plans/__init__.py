"""Corpora, the compiler of the pipe language, and the fluent builder."""
