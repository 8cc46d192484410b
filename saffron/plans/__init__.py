"""Queries over the benchmark's tables and the SQL that checks them."""
