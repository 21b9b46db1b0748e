"""Retail sales analytics on Spark: ingest, clean, describe, label, segment, forecast."""
