"""Operators for preparing training data: ten components, each usable on its own."""
