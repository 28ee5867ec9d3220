"""Operators for preparing training text at scale: filters, deduplication, mixing, encoding."""
