"""Operators: graphs and relations in, graphs and relations out."""
