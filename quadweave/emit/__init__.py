"""Byte-deterministic writers."""
