"""Queries on the TPC-H-like test tables, and SQL that states their results."""
