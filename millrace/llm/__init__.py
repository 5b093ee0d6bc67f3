"""Operators for preparing language-model training data. Nothing else in millrace imports this."""
