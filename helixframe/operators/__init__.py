"""Relational operators: validation, fragments, pairing, dictionary, scoring, comparison, reports."""
