"""DataFrame operators: filters, deduplication, matching, ledger, reports."""
