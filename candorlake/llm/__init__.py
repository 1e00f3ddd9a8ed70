"""Operators that prepare training text: packing, cleaning, deduplication, scoring.

Nothing outside this folder imports it; it may be removed as a whole.
"""
