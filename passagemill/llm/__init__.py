"""Operators that a training-data pipeline needs, one module for each.

Nothing outside this folder (but ``__spark_entry__.py`` and
``corpus_pipeline.py``) imports it.
"""
