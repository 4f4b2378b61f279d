"""Operators for preparing training data at scale.

Nothing outside this package imports it: ``__spark_entry__.py`` adds its named
queries when the package is present, and ``corpus_pipeline.py`` chains five of
the operators into one job.
"""
