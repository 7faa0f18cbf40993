"""Stores fed by streams."""
