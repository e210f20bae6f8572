"""Training-data operators: filters, near duplicates, scoring, tokens and packing.

Nothing else in the library imports this subpackage; ``queries`` holds the
registered queries and their SQL.
"""
