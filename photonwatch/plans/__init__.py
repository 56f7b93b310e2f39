"""Registered queries: operators bound to the driver tables, with their SQL checks."""
