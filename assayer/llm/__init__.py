"""Training-data operators: filtering, deduplication, tokenisation and scanning of document corpora.

Nothing outside this subpackage imports it; it can be deleted without effect on the rest.
"""
