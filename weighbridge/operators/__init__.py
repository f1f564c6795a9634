"""Relational operators of the audit, one module per concern."""
