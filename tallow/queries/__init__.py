"""Registered queries: each module has QUERIES and ORACLE_SQL."""
