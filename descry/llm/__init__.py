"""Operators for large training-data pipelines; nothing else in descry imports this package."""
