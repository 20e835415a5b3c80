"""Readers and writers: CSV, SQL dumps, predictions, accuracy tables, the catalog."""
