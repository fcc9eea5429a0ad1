"""Operators that prepare text for language-model training. Nothing outside this package imports it."""
