"""Relational operators over scripts, lines and reports."""
