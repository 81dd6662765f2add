"""Operators that prepare text collections for training; nothing else in the package imports them."""
