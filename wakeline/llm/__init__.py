"""Operators of a training-data pipeline: tokens on disk, archives, similarity, fingerprints, languages, repeats, mixing, rules."""
