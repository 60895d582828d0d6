"""Operators for large training corpora: one module each, see ``queries`` for the registered forms."""
