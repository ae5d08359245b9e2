"""Operators for training text: packing, leaks of evaluation texts, reading level. Nothing else in the library imports this."""
