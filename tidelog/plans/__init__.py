"""Decisions about what to run; nothing here touches data."""
