"""Structured Streaming form of the request intake and run log."""
