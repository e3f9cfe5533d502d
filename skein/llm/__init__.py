"""Operators for preparing language-model training data; nothing else in skein imports them."""
