"""Training-data operators for large text, page and vector tables.

Nothing outside this subpackage (and ``corpus_pipeline.py``) imports it; the
registered queries and their SQL are in ``queries.py``.
"""
