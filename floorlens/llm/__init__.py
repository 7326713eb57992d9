"""Operators for large-scale training-data pipelines over documents and web pages."""
