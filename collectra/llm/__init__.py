"""Operators of a large training-data pipeline: scoring, filters, near-duplicates, decontamination, secrets and packing."""
