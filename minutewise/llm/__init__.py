"""Operators for preparing training text: one module an operator, see the README."""
