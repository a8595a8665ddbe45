"""Operators that prepare text and vectors for model training.

Nothing outside this subpackage imports it; it may import the core.
"""
