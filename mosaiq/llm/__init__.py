"""Operators for preparing large text corpora; nothing else in mosaiq imports this package."""
