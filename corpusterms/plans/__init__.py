"""Registered queries (catalog) and their SQL twins (oracle)."""
