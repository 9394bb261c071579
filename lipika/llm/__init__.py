"""Operators for preparing language-model training data; nothing else in lipika imports this."""
