"""Structured Streaming counterparts of the window and run operators."""
