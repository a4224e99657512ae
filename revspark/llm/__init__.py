"""Operators of a training-data pipeline: scans, dedup, classifiers, packing, media and token output.

Nothing else in the library imports this subpackage. Each operator has a module of its own
with a general interface; `queries` holds the thin, contract-bound queries over the tables.
"""
