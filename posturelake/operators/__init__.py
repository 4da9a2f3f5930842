"""Operators on evidence tables."""
