"""Relational and graph operators over the code model's tables."""
