"""Training-data operators: packing, list joins, deduplication, sharding, quality, BPE, PII, HTML.

Nothing else in ``millrace`` imports this subpackage; ``__spark_entry__`` adds its queries when it is present.
"""
