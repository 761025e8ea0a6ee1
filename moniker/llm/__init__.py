"""Operators for large text corpora; see the README's section on them."""
