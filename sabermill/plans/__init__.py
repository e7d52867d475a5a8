"""Queries that bind the operators to tables, each with independent SQL where SQL can express it."""
