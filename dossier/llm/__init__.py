"""Operators of a training-data pipeline: tokens, languages, duplicates, mixing, media, vectors, toxicity.

Nothing outside this folder imports it. Each operator has a module of its own;
``queries`` binds them to the given tables.
"""
