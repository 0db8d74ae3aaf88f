"""Operators for training-data pipelines over the tables ``documents`` and ``embeddings``.

Nothing outside this package imports it.  ``loanloom.llm.queries`` has the named queries.
"""
