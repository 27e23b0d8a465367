"""Registered end-to-end queries and their SQL counterparts."""
