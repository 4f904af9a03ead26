"""Operators for large training-data corpora; nothing else imports this."""
