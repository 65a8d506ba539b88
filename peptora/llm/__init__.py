"""Corpus preparation operators for training data (text, media and URL tables)."""
