"""Operators on tables of names and clusters."""
