"""Operators for preparing text corpora for language-model training.

Nothing else in the package imports this folder; ``__spark_entry__`` adds its
queries (``txrisk.llm.queries``) only when it can be imported.
"""
