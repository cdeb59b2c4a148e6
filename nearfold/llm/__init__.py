"""Operators for preparing training text: near-duplicate joins, token files, quality rules, packing and more."""
