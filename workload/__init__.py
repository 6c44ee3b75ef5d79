"""Queries over the given tables: each one as a Spark job and as plain SQL."""
