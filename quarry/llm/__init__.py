"""Operators for large-scale text-training data; nothing else in the library imports this subpackage."""
