"""Operators for a training-data pipeline on ``documents``-like tables.

Nothing outside this folder (and ``corpus_pipeline.py``) imports it.
"""
