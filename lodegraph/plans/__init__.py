"""Whole rankings."""
