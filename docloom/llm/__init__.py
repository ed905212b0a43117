"""Operators for preparing language-model training data; nothing else in docloom imports this."""
