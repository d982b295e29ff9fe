"""Whole flows, from sources to tables."""
