"""Grouped DataFrame operators: each takes `by` keys and returns a lazy DataFrame."""
