"""Readers: relational tables, Markdown files, Turtle, JSON-LD, version history."""
