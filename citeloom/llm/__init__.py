"""Training-data operators: tokenisation, packing, dedup, fingerprints, chat, quality, PII.

Nothing else in the library imports this subpackage.
"""
