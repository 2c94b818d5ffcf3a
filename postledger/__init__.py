"""Postings ledger on Spark: collect, clean, match, track and report postings."""
