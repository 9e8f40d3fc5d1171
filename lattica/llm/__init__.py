"""Operators of a training-data pipeline: token output, search, text classifiers, mixing, tokenising, deduplication, sharding."""
