"""Lint rules over Go trees."""
