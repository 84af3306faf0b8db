"""Readers: metadata files in, graph relations out."""
