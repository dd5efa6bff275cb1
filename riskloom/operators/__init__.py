"""Reusable DataFrame operators: joins, top-k, dedupe, contracts, data tests, retrieval."""
