"""Queries over the given tables: the library's reports and ingest rules, with SQL to check them."""
