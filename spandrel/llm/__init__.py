"""Operators that prepare text and code for training language models. Nothing outside this package imports it."""
