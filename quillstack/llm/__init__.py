"""Operators for preparing training text: one module an operator, one query each in ``queries``."""
