"""Operators for preparing training corpora: text filters, deduplication, mixing, packing, web archives."""
