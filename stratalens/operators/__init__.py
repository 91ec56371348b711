"""Relational operators over the engine tables."""
