"""Declarative mapping documents and their validation."""
