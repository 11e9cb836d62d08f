"""Operators for training data: scans, deduplication, quality, decontamination and tokens."""
