"""Operators for the preparation of training text, each by one named method."""
