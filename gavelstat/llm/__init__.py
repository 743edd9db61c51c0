"""Operators for training-data pipelines over large text tables; nothing else in the library imports this package."""
