"""Operators of a training-data pipeline over text, pages, conversations and vectors."""
