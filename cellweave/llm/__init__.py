"""Operators for preparing language-model training data, ten in all, one module each."""
