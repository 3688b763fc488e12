"""Operators that prepare text, page and embedding tables for model training."""
