"""Relational, graph, citation and memory operators."""
