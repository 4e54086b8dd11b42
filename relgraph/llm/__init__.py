"""Operators for training data: filters, deduplication, packing, sharding and token files.

Every module holds one operator with a general interface; ``queries`` derives the
registered results from them. Nothing outside of this folder imports it.
"""
