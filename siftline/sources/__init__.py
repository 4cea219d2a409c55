"""Readers of the formats the engine takes in."""
