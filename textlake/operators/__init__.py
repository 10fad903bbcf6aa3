"""Relational and kernel operators over the token table."""
