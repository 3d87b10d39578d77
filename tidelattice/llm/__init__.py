"""Training-data operators: scoring, rules, near duplicates, mixing, packing.

Nothing else in the library imports this subpackage. Each module holds one
operator with its own interface; `queries` holds the thin catalogue queries.
"""
