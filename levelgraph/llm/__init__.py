"""Operators for the preparation of training data for language models. Nothing outside imports this package."""
