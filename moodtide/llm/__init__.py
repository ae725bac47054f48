"""Operators for preparing training data for language models at large scale."""
