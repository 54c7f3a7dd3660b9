"""Operators for preparing training data: filters, near copies, formatting, encoding and sharding of documents."""
