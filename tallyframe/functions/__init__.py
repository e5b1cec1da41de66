"""Aggregate column expressions."""
