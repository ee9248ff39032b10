"""Operators of a training-data pipeline: each is a DataFrame-to-DataFrame function.

``queries`` binds them to the ``documents`` and ``embeddings`` tables.
"""
