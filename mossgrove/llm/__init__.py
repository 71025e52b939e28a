"""Operators of a training-data pipeline: near-duplicates, nearest neighbours, classifiers,
rules, scans, link trust, source mixing and packing. Nothing outside this subpackage imports it."""
