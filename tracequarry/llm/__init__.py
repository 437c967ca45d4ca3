"""Operators for training data of language models. Nothing outside imports this package."""
