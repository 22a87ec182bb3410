"""Operators over instance, prediction and record tables."""
