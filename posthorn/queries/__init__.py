"""Registered queries by area. Each module has QUERIES and ORACLE with equal names."""
