"""Training-data operators: filters, scans, near-duplicate search and models.

Nothing outside this package imports it.  Queries and their SQL are in
``plumbline.llm.registry``.
"""
