"""Operators for preparing training text: one module for each, with its query beside it."""
