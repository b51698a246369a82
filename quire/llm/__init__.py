"""Operators for preparing language-model training data; nothing else in quire imports this subpackage."""
