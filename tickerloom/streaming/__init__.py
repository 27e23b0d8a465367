"""Structured Streaming form of the daily refresh chain."""
