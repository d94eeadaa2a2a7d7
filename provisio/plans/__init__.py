"""Registered queries: operators bound to the given tables, each with SQL that says the same."""
