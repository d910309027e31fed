"""Operators for preparing training data on Spark; nothing else in the library imports them."""
