"""Chunked and streaming operators."""
