"""Operators for preparing training text: sharding, extraction, deduplication, counting, scoring, mixing."""
