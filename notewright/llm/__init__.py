"""Operators for text collections that train language models."""
