"""Operators of a training-data pipeline: dedup, scans, classifiers, mixing, sharding."""
