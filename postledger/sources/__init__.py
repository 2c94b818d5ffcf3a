"""Readers that turn landed files and payload columns into postings."""

from postledger.sources.registry import load_source, load_sources, select_sources

__all__ = ["load_source", "load_sources", "select_sources"]
