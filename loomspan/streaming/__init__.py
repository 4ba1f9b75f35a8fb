"""Stateful instances of graphs, on batches and on streams."""
