"""Operators for entity data and training data; nothing else in the library imports this subpackage."""
