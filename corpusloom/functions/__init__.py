"""Column functions and per-document text functions."""
