"""Incremental forms of the ledger."""
