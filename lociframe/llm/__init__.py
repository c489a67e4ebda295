"""Operators for training-data pipelines: documents and web pages in, decisions per document out."""
