"""Operators for preparing training data from a corpus of documents, pages and labels."""
