"""Operators: kernels that make rows of one document, and DataFrame plans on top of them."""
