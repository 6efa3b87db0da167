"""Operators that prepare text corpora for training language models.

Nothing outside this folder (and corpus_pipeline.py) imports it; queries are
listed in :mod:`gridloom.llm.registry`.
"""
