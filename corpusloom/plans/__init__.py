"""Whole plans: building and searching an index, and the queries over the test tables."""
