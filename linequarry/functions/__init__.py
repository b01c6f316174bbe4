"""Scalar functions: character classes, cleaning, predicates, dialogue parsing, decoding."""
