"""Operators for preparing training text: each module holds one operator; ``queries`` applies them to the given tables."""
