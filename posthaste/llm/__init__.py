"""Operators of a training-data pipeline, from raw documents to mixed shards."""
