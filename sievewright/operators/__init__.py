"""Relational operators on corpora, spans and reports."""
