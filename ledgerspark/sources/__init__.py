"""Readers of control files and ledgers, and the tables that are written."""
