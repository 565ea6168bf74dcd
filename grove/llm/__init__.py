"""Operators for preparing training data at scale; nothing else in grove imports this."""
