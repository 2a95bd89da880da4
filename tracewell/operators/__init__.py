"""Relational operators, parameterised by columns."""
