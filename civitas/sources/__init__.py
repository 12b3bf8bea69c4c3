"""Readers, writers and load checks (Parquet, CSV, JSON, seeds)."""
