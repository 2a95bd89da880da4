"""Readers of binary evidence as table functions, and writers of reports."""
