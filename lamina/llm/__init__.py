"""Operators for training-data pipelines over text, media and URLs."""
