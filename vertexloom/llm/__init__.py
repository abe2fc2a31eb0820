"""Operators that prepare training data: extraction, filters, deduplication, packing, models."""
