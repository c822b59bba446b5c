"""The pipe language: tokens, syntax tree and parser."""
