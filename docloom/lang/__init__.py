"""The pipe language: tokens, syntax tree, parser."""
