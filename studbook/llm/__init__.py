"""Operators for training-data corpora: filtering, duplicate search, archives, packing and fingerprints."""
