"""Registered plans: each query with the SQL that checks it."""
