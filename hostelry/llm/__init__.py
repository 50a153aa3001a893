"""Operators for preparing training data: documents, pages and conversations in, decisions and digests out."""
