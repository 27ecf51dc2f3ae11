"""Whole jobs, the query registry, and the SQL that checks it."""
