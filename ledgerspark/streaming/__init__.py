"""Micro-batch feed of the ingest plan."""
