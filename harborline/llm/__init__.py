"""Operators for building training corpora: mixing, extraction, fingerprints, packing, filtering and near-duplicates."""
