"""Registered queries: operators over the test tables, each beside SQL with the same result."""
