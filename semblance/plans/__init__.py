"""Whole jobs over the operators: ingest, train, generate, evaluate."""
