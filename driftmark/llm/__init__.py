"""Training-data operators: quality, tokenising, URL rules, archives, near
duplicates, vector search, chat layouts, secrets, toxicity and packing.

Nothing else in the library imports this subpackage.
"""
