"""Queries assembled from the operators, and their registry."""
