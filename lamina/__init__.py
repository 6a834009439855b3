"""Layered batch tables on Spark: load raw records, clean them, summarize them,
keep keyed tables up to date, and check the result."""
