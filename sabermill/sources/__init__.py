"""Reads and writes of tables, JSON feeds, ledgers and snapshots."""
