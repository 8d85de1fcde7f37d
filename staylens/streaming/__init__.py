"""Streaming form of the scoring flow."""
