"""Operators for training-data corpora: fingerprints, dedup, mixing, scoring, packing."""
