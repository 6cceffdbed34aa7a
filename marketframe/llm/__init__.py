"""Operators for preparing training text and vectors: each module holds one operator and its registered query."""
