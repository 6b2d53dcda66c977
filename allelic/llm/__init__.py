"""Training-data operators: sharding, dedup, search, scoring, mixing, tokens, packing.

Nothing else in the library imports this subpackage; ``queries.py`` lists its
queries for the entry module.
"""
