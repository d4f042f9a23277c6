"""Operators that a large training-data pipeline needs; nothing else imports this package."""
