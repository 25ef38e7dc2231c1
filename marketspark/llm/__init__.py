"""Operators of a training-data pipeline over ``documents``, ``pages``, ``labels``, ``benchmark`` and ``embeddings``."""
