"""Training-data operators: archives, deduplication, scoring, search, formatting, mixing.

Self-contained: nothing outside this package imports it.
"""
