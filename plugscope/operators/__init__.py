"""Relational operators over the fact base."""
