"""Registered queries: operators over data that Spark derives from the given tables, and the SQL they're held against."""
