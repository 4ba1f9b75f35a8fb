"""Graphs as values, and their compilation to DataFrame expressions."""
