"""Operators for large training-text corpora and the queries that apply them.

Nothing else in the library imports this subpackage. Operators: substring dedup, token files,
packing, n-gram Jaccard join, benchmark decontamination, license scan, secret scan, quality
classifier, URL filter, exact top-k search. ``queries`` registers them.
"""
