"""Operators on tables of points, pairs, clusters and edges."""
