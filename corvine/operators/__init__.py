"""Relational, retrieval and evaluation operators."""
