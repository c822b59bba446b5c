"""Operators over the ordered events of each entity. Each takes DataFrames and columns and can be used
without the language."""
