"""Queries over the operators, each with its SQL."""
