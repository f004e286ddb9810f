"""Readers and writers: CSV sources, layered Parquet tables, scratch tables."""
