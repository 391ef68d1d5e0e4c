"""Graphs from relational tables, and the registered queries."""
