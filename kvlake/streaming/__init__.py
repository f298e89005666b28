"""Streaming over an operation log."""
