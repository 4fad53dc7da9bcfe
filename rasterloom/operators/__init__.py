"""Operators over pixel relations."""
