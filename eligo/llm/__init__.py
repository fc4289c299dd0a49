"""Training-data operators: mixing, dedup, classifiers, tokens, archives and vector search.

Nothing else in the library imports this subpackage.
"""
