"""Operators that prepare text for language-model training.

Nothing outside this subpackage imports it, so it can be removed as a whole.
"""
