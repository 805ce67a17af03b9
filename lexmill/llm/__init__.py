"""Operators for preparing training data at corpus scale. Nothing else in lexmill imports this package."""
