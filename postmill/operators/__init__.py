"""Relational operators over mail tables."""
