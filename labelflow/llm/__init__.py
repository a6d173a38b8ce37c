"""Operators for preparing language-model training data on Spark.

Nothing outside this package imports it.  ``queries.py`` registers one query
per operator and ``corpus_pipeline.py`` at the repository top chains five.
"""
