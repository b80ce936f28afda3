"""Operators for training-data pipelines.

Nothing else in the library imports this subpackage; deleting it, its tests
and ``corpus_pipeline.py`` leaves the rest working.
"""
