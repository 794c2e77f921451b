"""Readers of plugin corpora, listings and reports."""
