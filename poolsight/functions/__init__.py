"""Column-level building blocks: each returns a Catalyst expression, never a Python UDF."""
