"""Operators over evidence, manifests and graphs: DataFrames in, DataFrames out."""
