"""Queries over the test tables, one per operator, and the SQL each result must equal."""
