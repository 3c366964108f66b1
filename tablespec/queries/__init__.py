"""Queries over the test tables, one for each operator."""
