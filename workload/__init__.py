"""Queries over the given tables, one per operator, with an SQL twin for each."""
