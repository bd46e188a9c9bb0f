"""Structured Streaming form of the per-user block loop."""
