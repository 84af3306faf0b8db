"""Graphs from streams of graph documents."""
