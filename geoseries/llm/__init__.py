"""Operators for building language-model corpora."""
