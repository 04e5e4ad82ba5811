"""Training-data operators: deduplication, classifiers, PII, archives, packing.

Nothing outside this subpackage (and ``corpus_pipeline.py``) imports it.
"""
