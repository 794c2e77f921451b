"""Incremental analysis of changed plugins."""
