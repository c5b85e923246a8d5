"""Training-data operators: language id, WARC, tokenizers, quality, PII and near-duplicate search.

Nothing else in the package imports this subpackage.
"""
