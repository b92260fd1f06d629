"""Graph, search and retrieval operators over the triple table."""
