"""Operators for training-corpus pipelines; nothing else in the library imports them."""
