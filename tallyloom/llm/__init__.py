"""Operators of a language-model training-data pipeline; nothing else in the library imports this package."""
