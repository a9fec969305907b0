"""Operators for preparing text corpora for language-model training.

Nothing outside this folder (but for ``corpus_pipeline.py``) imports it.
"""
