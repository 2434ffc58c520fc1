"""Whole plans: features of a corpus, scoring, selection, and the registered queries."""
