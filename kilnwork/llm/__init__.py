"""Operators of a training-data pipeline: packing, quality, tokens, dedup, licences, URLs.

Nothing outside this subpackage imports it; ``queries`` holds the registered queries.
"""
