"""Operators of a training-data pipeline over document, page and conversation tables.

Nothing else in the library imports this subpackage. Each module holds one
operator with its own general interface and the thin query that applies it;
``registry`` lists the queries and their SQL.
"""
