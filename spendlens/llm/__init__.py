"""Operators of a training-data pipeline over ``documents``, ``labels``,
``benchmark`` and ``conversations``.  Nothing outside this package and
``corpus_pipeline.py`` imports it."""
