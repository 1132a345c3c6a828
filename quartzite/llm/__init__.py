"""Operators that prepare training text for language models. Nothing else in the library imports this."""
