"""Graphs to text and JSON: full graphs by distributed writers, small ones as strings."""
