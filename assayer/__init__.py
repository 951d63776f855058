"""Assayer: evidence analytics over text, binary and repository corpora on Spark."""
