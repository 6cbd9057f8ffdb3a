"""Operators of a training-data pipeline: packing, decontamination, dedup, scans, sharding, filters, extraction."""
