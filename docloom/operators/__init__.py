"""Operators over the engine's relations."""
