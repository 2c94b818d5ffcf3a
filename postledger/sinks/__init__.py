"""Writers: CSV exports, landing rewrites, ledger snapshots."""
