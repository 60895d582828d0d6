"""Compositions of operators, and the registry of runnable queries."""
