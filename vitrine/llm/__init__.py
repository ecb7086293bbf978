"""Operators of a training-data pipeline on document tables; nothing else of the library uses them."""
