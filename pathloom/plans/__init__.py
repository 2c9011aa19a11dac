"""Registered queries: operators over views of the test tables, with SQL."""
