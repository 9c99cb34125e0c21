"""Readers and writers of control tables, corpora, keys and indexes."""
