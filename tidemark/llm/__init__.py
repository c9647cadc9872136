"""Operators that prepare text for training: ten methods, their queries and their SQL."""
