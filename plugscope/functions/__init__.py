"""Scalar rules as Spark columns and plain functions."""
