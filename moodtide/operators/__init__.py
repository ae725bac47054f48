"""Relational operators over bars, scores, curves and holdings."""
