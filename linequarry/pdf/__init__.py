"""Typeset PDF: fonts, line breaking, pages, the file."""
