"""Operators for preparing training data: packing, filters, deduplication, mixing."""
