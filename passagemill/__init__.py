"""Semantic document chunking as Spark DataFrame transformations.

A document is one row; its paragraphs, atoms, similarities, boundaries and chunks are array
columns of that row. Every operator maps arrays to arrays, so a corpus of any size runs without
a shuffle until its chunks are exploded for a sink.
"""

__version__ = "0.1.0"
