"""Training-data operators: quality, dedup, PII, mixing, packing, sharding, media, chat.

Nothing else in the library imports this subpackage.
"""
