"""Structured Streaming entry points; each feeds the batch operators."""
