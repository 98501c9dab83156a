"""Operators for preparing training corpora: dedup, filters, models, mixing, binary output.

Nothing outside this package imports it; ``queries.py`` lists the registered queries.
"""
