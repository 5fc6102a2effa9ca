"""Queries over the input tables and the SQL they are checked with."""
