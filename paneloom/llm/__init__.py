"""Operators on texts for training corpora. Nothing outside this package imports it."""
