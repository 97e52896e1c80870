"""Queries over the derived views, one module for each family of operators."""
