"""Whole jobs built from the operators, and the catalogue over the test tables."""
