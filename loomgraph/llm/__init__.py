"""Operators on training text: token ids, licenses, source mixtures and subjects."""
