"""Operators that prepare text and vector tables for model training."""
