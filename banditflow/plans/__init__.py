"""Iterative replays built from the operators (two-stage, lazy, gossip)."""
