"""Training-data operators: quality, licences, toxicity, near copies, tokens, packing, media.

Nothing outside this package, ``corpus_pipeline.py`` and the guarded import of
``__spark_entry__.py`` uses it, so the folder can be taken away.
"""
