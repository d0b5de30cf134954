"""Operators for training-data pipelines: text, vectors, pages and conversations."""
